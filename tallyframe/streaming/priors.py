"""Hook priors kept up by a stream: decayed evidence by hook type as operator state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.priors import TAU

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("day", DoubleType()), StructField("n", DoubleType()), StructField("s", DoubleType())])


class DecayedEvidence(StatefulProcessor):
    """For each hook type the sum of weights and of weighted scores, as of the newest outcome's day.

    An outcome of day d weighs exp((d - day) / tau) as of `day`; when a newer one arrives the sums shrink
    by the days between, and an older one adds its smaller weight, so the order of arrival is nothing to
    the result. The state is three numbers a hook type, whatever the stream's length.
    """

    def __init__(self, tau: float = TAU) -> None:
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, Spark's names
        day, n, s = self.sums.get() if self.sums.exists() else (-math.inf, 0.0, 0.0)
        for pdf in rows:
            some = pdf[pdf.hqs.notna() & pdf.day.notna()]
            if not len(some):
                continue
            newest = max(day, float(some.day.max()))
            shrink = math.exp((day - newest) / self.tau) if n else 0.0
            weight = ((some.day - newest) / self.tau).map(math.exp)
            day, n, s = newest, n * shrink + float(weight.sum()), s * shrink + float((weight * some.hqs).sum())
        if n:
            self.sums.update((day, n, s))
            yield pd.DataFrame({"hook_type": [key[0]], "day": [day], "n": [n], "s": [s]})

    def close(self) -> None:
        pass


def decayed_evidence(outcomes: DataFrame, tau: float = TAU) -> DataFrame:
    """(hook_type, day, n, s) of a stream (hook_type, hqs, day): a row for each type that a batch touched.

    day: days since some origin. Rows without a score, day or type teach nothing. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass = ROCKS).
    """
    rows = outcomes.where("hook_type is not null").select("hook_type", F.col("hqs").cast("double").alias("hqs"), F.col("day").cast("double").alias("day"))
    return rows.groupBy("hook_type").transformWithStateInPandas(DecayedEvidence(tau), "hook_type string, day double, n double, s double", "Update", "None")


def as_of(evidence: DataFrame, day: float, tau: float = TAU) -> DataFrame:
    """(hook_type, n, s) as of a later day, of each type's newest row: what hook_priors() sums up in a batch."""
    last = evidence.groupBy("hook_type").agg(F.max_by(F.struct("day", "n", "s"), F.struct("day", "n")).alias("x"))
    shrink = F.exp((F.col("x.day") - day) / tau)
    return last.select("hook_type", (F.col("x.n") * shrink).alias("n"), (F.col("x.s") * shrink).alias("s"))
