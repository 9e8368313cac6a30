"""Operators for preparing training data at scale, and the queries that apply them.

Nothing else in the library imports this subpackage."""
