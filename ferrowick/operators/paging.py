"""Keyset pages with opaque cursors."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ModelError
from .filters import order_by


def encode_cursor(values: list) -> str:
    return base64.b64encode(json.dumps(values, default=str).encode()).decode()


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.b64decode(cursor))


def beyond(order: list[tuple[str, str]], values: list, schema) -> Column:
    """Rows after `values` in `order`, column by column in its own direction; nulls count as last."""
    out, equal = F.lit(False), F.lit(True)
    for (name, direction), value in zip(order, values, strict=True):
        here, mark = F.col(name), F.lit(value).cast(schema[name].dataType)
        if value is None:
            after = F.lit(False)
        else:
            after = here.isNull() | (here > mark if direction.startswith("asc") else here < mark)
        out = out | (equal & after)
        equal = equal & here.eqNullSafe(mark)
    return out


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    has_more: bool
    first: str | None
    last: str | None


def page(df: DataFrame, order: list[tuple[str, str]], first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> Page:
    """`first` rows after a cursor, or `last` rows before one, in `order`, which must end in a unique column.

    Only the page and one more row are read to the driver.
    """
    if (first is None) == (last is None):
        raise ModelError("a page has either first or last")
    flip = {"asc": "desc", "desc": "asc"}
    going = order if last is None else [(n, flip[d.split("_")[0]]) for n, d in order]
    cursor, size = (after, first) if last is None else (before, last)
    rows = df
    if cursor is not None:
        values = decode_cursor(cursor)
        if last is None:
            rows = df.where(beyond(going, values, df.schema))
        else:
            rows = df.where(~beyond(order, values, df.schema) & ~_same(order, values, df.schema))
    sort = order_by(going) if last is None else [F.col(n).desc_nulls_first() if d == "desc" else F.col(n).asc_nulls_first() for n, d in going]
    taken = rows.orderBy(*sort).limit(size + 1).collect()
    more, taken = len(taken) > size, taken[:size]
    if last is not None:
        taken = taken[::-1]
    keys = [n for n, _ in order]
    ends = [encode_cursor([r[k] for k in keys]) for r in (taken[:1] + taken[-1:])]
    return Page(df.sparkSession.createDataFrame(taken, df.schema), more, ends[0] if ends else None, ends[-1] if ends else None)


def _same(order: list[tuple[str, str]], values: list, schema) -> Column:
    out = F.lit(True)
    for (name, _), value in zip(order, values, strict=True):
        out = out & F.col(name).eqNullSafe(F.lit(value).cast(schema[name].dataType))
    return out
