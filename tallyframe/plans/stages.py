"""A registry of stages with fingerprints: a stage runs again only if its settings or what it depends on changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import fingerprint
from ..sources.readers import exists


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    depends: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()


@dataclass
class Plan:
    stages: list[Stage]
    config: dict
    folder: str
    ran: list[str] = field(default_factory=list)

    def fingerprints(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for s in self.stages:
            out[s.name] = fingerprint(s.name, {k: self.config.get(k) for k in s.settings}, [out[d] for d in s.depends])
        return out

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Every stage's rows; those whose fingerprint has been written before are read back."""
        done: dict[str, DataFrame] = {}
        for s in self.stages:
            path = f"{self.folder}/{s.name}/{self.fingerprints()[s.name]}"
            if not exists(spark, f"{path}/_SUCCESS"):
                s.run(spark, {d: done[d] for d in s.depends}).write.mode("overwrite").parquet(path)
                self.ran.append(s.name)
            done[s.name] = spark.read.parquet(path)
        return done
