"""Query registry: one entry per operator, with the SQL that must agree."""

from __future__ import annotations

from plotwise.fixtures import Views, with_views
from plotwise.session import configure

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register `fn(views) -> DataFrame` under `key`."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark, sf_dir):
            return fn(Views(configure(spark), sf_dir))

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return deco
