"""Whether stored copies are fresh, and the way in which changes of a source arrive."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ModelError
from ..mv.delta import content_hash

# Signals of change, and how what they announce is landed.
POLLED, PUSHED, TRIGGERED = ("ttl", "probe", "ttl_probe"), ("native", "debezium", "kafka"), ("signal",)
PROBES = {"watermark": "append", "hash": "replace", "count": "replace", "none": "replace"}


@dataclass
class Copy:
    """What is known of a copy: its last refresh, whether that went well, the source's token then and now, and what it is made of."""

    name: str
    refreshed: datetime | None = None
    ok: bool = True
    token_then: str | None = None
    token_now: str | None = None
    inputs: list[Copy] = field(default_factory=list)


@dataclass(frozen=True)
class Policy:
    """`ttl`: fresh for so long; `probe`: fresh while the token stays; both: the token is asked once the time is over.

    With `transitive` all inputs, at any depth, must be fresh too; one that is its own input is looked at once.
    """

    ttl: timedelta | None = None
    probe: bool = False
    transitive: bool = False

    def state(self, copy: Copy, now: datetime) -> str:
        """FRESH, STALE or FAILED."""
        pending, met = [copy], set()
        while pending:
            at = pending.pop()
            if id(at) in met:
                continue
            met.add(id(at))
            if (found := self._alone(at, now)) != "FRESH":
                return found
            if self.transitive:
                pending += reversed(at.inputs)
        return "FRESH"

    def _alone(self, copy: Copy, now: datetime) -> str:
        if not copy.ok:
            return "FAILED"
        if copy.refreshed is None:
            return "STALE"
        if self.ttl is not None and now - copy.refreshed < self.ttl:
            return "FRESH"
        if not self.probe:
            return "STALE"
        if copy.token_now is None:
            # Without a token the time that is over decides, if there is one.
            return "FAILED" if self.ttl is None else "STALE"
        return "FRESH" if copy.token_now == copy.token_then else "STALE"


def signal_of(table: str | None, source: str | None) -> str:
    """A table's signal, else its source's, else `ttl`."""
    found = table or source or "ttl"
    if found not in (*POLLED, *PUSHED, *TRIGGERED):
        raise ModelError(f"no change signal {found}")
    return found


def landing(signal: str, watermark: str | None = None) -> str:
    """How rows land: `cdc` where they are pushed, `append` where a watermark tells new ones, else `replace`."""
    if signal in PUSHED:
        return "cdc"
    return "append" if watermark else "replace"


def probe(df: DataFrame, kind: str, watermark: str | None = None) -> DataFrame:
    """One row: the token of a table by a probe's kind, as text. Only the watermark's column, or none for a count, is read."""
    if kind not in PROBES:
        raise ModelError(f"no probe {kind}")
    if kind == "watermark":
        if watermark is None:
            raise ModelError("a watermark probe needs its column")
        return df.agg(F.max(watermark).cast("string").alias("token"))
    if kind == "count":
        return df.agg(F.count("*").cast("string").alias("token"))
    if kind == "hash":
        return df.sparkSession.createDataFrame([(str(content_hash(df)),)], "token string")
    return df.sparkSession.createDataFrame([(None,)], "token string")
