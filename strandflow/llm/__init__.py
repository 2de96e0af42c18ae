"""Operators for training-data pipelines. Nothing outside this subpackage imports it, but for the registry of queries."""
