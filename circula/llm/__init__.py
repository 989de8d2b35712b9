"""Operators for training-data pipelines.  Nothing else in the library imports
this subpackage; its registered queries are in :mod:`circula.llm.queries`."""
