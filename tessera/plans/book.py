"""A module's queries with their oracles."""

from __future__ import annotations


def book():
    """(queries, oracles, decorator) of a module; the decorator takes a query's name and its SQL."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, oracle: str):
        def put(fn):
            queries[name], oracles[name] = fn, oracle
            return fn

        return put

    return queries, oracles, query
