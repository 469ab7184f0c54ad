"""Registered queries: each has a Spark form on the operators and, where SQL can say it, the same in SQL."""

from quorumlake.queries import corpus, plans, selection, sources, votes
from quorumlake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "plans", "selection", "sources", "votes"]
