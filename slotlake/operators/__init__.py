"""DataFrame operators; each takes a frame and returns a lazy frame."""
