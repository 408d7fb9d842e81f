"""Registered queries and their oracle statements."""


def load() -> tuple[dict, dict]:
    from . import aggregates, archive, dashboards, lineage, relational, spatial, streams  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
