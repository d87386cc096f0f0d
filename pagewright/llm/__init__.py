"""Operators for training-data pipelines. Nothing else in pagewright imports this subpackage."""
