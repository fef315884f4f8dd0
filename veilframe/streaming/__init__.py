"""The stateless rewrites on a stream of text files."""
