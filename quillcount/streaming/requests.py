"""Extension: running estimates of requests whose sources keep arriving.

A request is a key with state: what every source (kind, label) adds to the
request's sums, and their totals. A repeated source changes nothing, a source
that comes again with other content takes the place of the old one. The totals
before and after each batch leave the state; the counts, and whether a limit
was passed between the two, are ordinary columns over them. When event time has
moved past the last source of a request by ``silent``, its final estimate is
given and its state forgotten; what comes later starts the request anew.

State is kept by the RocksDB provider, which Spark needs for it
(``spark.sql.streaming.stateStore.providerClass``): on disk, an entry for each
source of the requests that are still open.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.counters import heuristic
from ..functions.text import CLASSES
from ..operators.analyze import PARTS, countable, source_sums, with_joints

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUES = ", ".join(f"{p} bigint" for p in PARTS)
_TOTALS = ("n_sources", *PARTS)
_OUT = "request_id string, final boolean, " + ", ".join(f"{side}_{t} bigint" for side in ("before", "after") for t in _TOTALS)


class RequestTotals(StatefulProcessor):
    """Totals of a request's sources, each counted once, as last seen."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", "kind string, label string", f"sha256 string, {_VALUES}")
        self.totals = handle.getValueState("totals", "n_sources bigint, " + _VALUES + ", last_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        known = self.totals.get()
        before = [int(v) for v in known[:-1]] if known else [0] * len(_TOTALS)
        last, after = (int(known[-1]) if known else 0), list(before)
        for frame in rows:
            last = max(last, int(frame["ts_ms"].max()))
            for kind, label, sha, *values in frame[["kind", "label", "sha256", *PARTS]].itertuples(index=False, name=None):
                old = self.sources.getValue((kind, label)) if self.sources.containsKey((kind, label)) else None
                if old is not None and old[0] == sha:
                    continue
                values = [int(v) for v in values]
                gone = [int(v) for v in old[1:]] if old is not None else [0] * len(PARTS)
                after[0] += old is None
                after[1:] = [t + v - g for t, v, g in zip(after[1:], values, gone, strict=True)]
                self.sources.updateValue((kind, label), (sha, *values))
        if known:
            self.handle.deleteTimer(int(known[-1]) + self.silent_ms)
        self.handle.registerTimer(last + self.silent_ms)
        self.totals.update((*after, last))
        yield self._row(key, False, before, after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.totals.get()
        if known:
            totals = [int(v) for v in known[:-1]]
            self.sources.clear()
            self.totals.clear()
            yield self._row(key, True, totals, totals)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, final: bool, before: list, after: list) -> pd.DataFrame:
        names = ["request_id", "final", *(f"{side}_{t}" for side in ("before", "after") for t in _TOTALS)]
        return pd.DataFrame([[key[0], final, *before, *after]], columns=names)


def _tokens(rows: DataFrame, side: str, family: str) -> DataFrame:
    """``rows`` with the input estimate of the totals of one side: joined texts and what wrapping adds."""
    own = with_joints(rows.select("*", *[F.col(f"{side}_{t}").alias(t) for t in _TOTALS]))
    count = {p: heuristic(family, {c: F.col(f"{p}_{c}") for c in CLASSES}, F.col("invalid")) for p in ("raw", "wrapped")}
    extra = lambda a, b: F.greatest(F.lit(0).cast("long"), count["wrapped"][a] - count["raw"][b])
    value = F.struct((count["raw"]["tokens"] + extra("tokens", "tokens")).alias("tokens"), (count["raw"]["low"] + extra("low", "high")).alias("low"), (count["raw"]["high"] + extra("high", "low")).alias("high"), "n_sources", "total_bytes")
    return own.withColumn(side, value).drop(*[c for c in own.columns if c not in rows.columns])


def running_estimates(sources: DataFrame, limit: int, family: str = "legacy", late: str = "10 minutes", silent_seconds: int = 600) -> DataFrame:
    """Events of a stream of text sources (``text_sources`` columns and ``ts``): a row when a request's input estimate passes ``limit`` tokens, and its final one.

    Columns: request_id, event (``over`` or ``final``), n_sources, total_bytes,
    tokens, low, high. Rows later than ``late`` behind the newest of the batches
    before the last one are dropped.
    """
    base = countable(sources.withColumnRenamed("bytes", "source_bytes").withWatermark("ts", late)).withColumnRenamed("bytes", "text_bytes")
    rows = source_sums(base).select("request_id", "kind", "label", "sha256", "ts", F.unix_millis("ts").alias("ts_ms"), *PARTS)
    states = rows.groupBy("request_id").transformWithStateInPandas(RequestTotals(silent_seconds * 1000), _OUT, "Append", "EventTime")
    out = _tokens(_tokens(states, "before", family), "after", family)
    over = (F.col("before.tokens") <= limit) & (F.col("after.tokens") > limit)
    return out.where(F.col("final") | over).select("request_id", F.when(F.col("final"), "final").otherwise("over").alias("event"), "after.n_sources", "after.total_bytes", "after.tokens", "after.low", "after.high")
