"""Operators for training-data pipelines. Nothing else in orfweave imports this subpackage."""
