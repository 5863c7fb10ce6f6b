"""Operators for large training-text pipelines.  Nothing else in ``plait`` imports this subpackage."""
