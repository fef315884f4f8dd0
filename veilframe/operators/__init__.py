"""DataFrame operators: detection, segments, rewriting, parts, routing."""
