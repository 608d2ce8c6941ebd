"""Composed queries over the test tables, each with an equivalent SQL where SQL can say it."""

from corpusloom.plans.catalog import ORACLES, QUERIES


def load_all() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracles)."""
    from corpusloom.plans import answers, chunks, evaluation, logs, meetings, pages, retrieval, tags  # noqa: F401

    return QUERIES, ORACLES
