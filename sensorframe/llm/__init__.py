"""Operators for preparing training data at scale; see ``queries.py`` for the registered queries."""
