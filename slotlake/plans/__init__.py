"""Jobs composed of operators: features, training, scoring."""
