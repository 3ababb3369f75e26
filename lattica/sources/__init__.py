"""Inputs: test-table projections, source trees, lock files, labels and configuration."""
