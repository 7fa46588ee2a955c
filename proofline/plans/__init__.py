"""Registered queries over the shared test tables, each beside its check SQL."""
