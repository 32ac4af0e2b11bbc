"""Thin ``spark-submit`` entry points; all work is in operators and plans."""
