"""Whole runs: strategies, summary, timing."""
