"""Registered queries: each a function of the views, with the SQL text that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.sources.shipping import ship
from canopy.sources.views import VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_DIALECT = {"{h}": "to_hours(cast(o_orderkey%24 as int))", "{d}": "date_diff('hour', timestamp '2024-01-01', ts)"}


def _view_sql(text: str) -> str:
    for mark, sql in _DIALECT.items():
        text = text.replace(mark, sql)
    return re.sub(r"\{(\w+)\}", r"\1", text)


_CTES = {name: _view_sql(text) for name, text in VIEWS.items()} | {
    "tracking": "select distinct tracking_id, video_id from tff where tracking_id is not null",
    "vec": "select vec_id as id, label, partition, individual_video_id, fold, embedding::double[] as v from emb",
    "spans": "select video_id, tracking_id, min(frame_nr) as f0, max(frame_nr) as f1 from tff where tracking_id is not null group by all",
    "hashed_image": "select *, upper(split_part(file_name, '_', 1)) as label, (image_id*2654435761)%4294967296 as h, (image_id*2654435761+1)%4294967296 as h1 from image",
}
_NEEDS = {"tracking": ("tff",), "vec": ("emb",), "spans": ("tff",), "hashed_image": ("image",)}


def with_views(sql: str) -> str:
    """sql with the views that it names before it."""
    named: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            add(x)
        if name not in named:
            named.append(name)

    for name in _CTES:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b|,\s*{name}\s+\w+\s*(,|where|$)", sql):
            add(name)
    if not named:
        return sql
    ctes = ",\n".join(f"{n} as ({_CTES[n]})" for n in named)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of Views; sql, where given, must have its column names and rows."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Views(ship(spark), sf_dir))
        if sql:
            ORACLE[key] = with_views(sql)
        return f

    return register
