"""Collectors' append logs as a Spark data source, and which platform can be collected.

    spark.dataSource.register(AppendLogs)
    spark.read.format("append_logs").option("path", folder).schema(...).load()

A folder holds one log a platform, <platform>.jsonl. A file is cut into blocks of whole lines, each a
partition; filters on the platform choose files before any is opened, filters on other columns by
equality drop lines as they are read. Blank lines are skipped; a line that is no JSON object becomes a
row with only platform and `_corrupt` (if the schema has it), else it is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

BLOCK = 32 << 20


class Block(InputPartition):
    """Bytes start to end of a log: the lines that begin in it."""

    def __init__(self, path: str, platform: str, start: int, end: int) -> None:
        self.path, self.platform, self.start, self.end = path, platform, start, end


class AppendLogs(DataSource):
    """Options: path, a local or shared folder or a URI that pyarrow opens; block, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "append_logs"

    def schema(self) -> str:
        return "platform string, post_id string, window string, collected_at string, call string, body string, _corrupt string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return AppendLogReader(schema, self.options["path"], int(self.options.get("block", BLOCK)))


class AppendLogReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, block: int) -> None:
        self.columns, self.path, self.block = schema, path, block
        self.platforms: set[str] | None = None
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802, Spark's name
        """Takes equality and membership filters on plain columns; the others are Spark's to apply."""
        timed = {f.name for f in self.columns if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)}
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] in timed:
                yield f
            elif f.attribute[0] == "platform":
                self.platforms = values if self.platforms is None else self.platforms & values
            else:
                self.equal[f.attribute[0]] = self.equal.get(f.attribute[0], values) & values

    def _files(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return store, [x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name.endswith(".jsonl")]

    def partitions(self) -> list[Block]:
        found = []
        for x in sorted(self._files()[1], key=lambda x: x.path):
            platform = x.base_name.removesuffix(".jsonl")
            if self.platforms is None or platform in self.platforms:
                found += [Block(x.path, platform, a, min(x.size, a + self.block)) for a in range(0, x.size, self.block)]
        return found or [Block("", "", 0, 0)]

    def read(self, partition: Block) -> Iterator[tuple]:
        names = [f.name for f in self.columns]
        if not partition.path:
            return
        store, _ = self._files()
        with store.open_input_file(partition.path) as file:
            lines = self._lines(file, max(0, partition.start - 1))
            if partition.start:  # the line that runs into this block belongs to the one before
                next(lines, None)
            for at, line in lines:
                if at >= partition.end:
                    break
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                except ValueError:
                    row = None
                if not isinstance(row, dict):
                    if "_corrupt" not in names:
                        continue
                    row = {"_corrupt": line.decode("utf-8", "replace").rstrip("\r\n")}
                row = {k: v if v is None or isinstance(v, str | int | float | bool) else json.dumps(v, ensure_ascii=False) for k, v in row.items()} | {"platform": partition.platform}
                if all(row.get(k) in v for k, v in self.equal.items()):
                    yield tuple(row.get(n) for n in names)

    @staticmethod
    def _lines(file, at: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
        """(place, line) from a place on; the last line may lack its end."""
        file.seek(at)
        rest = b""
        while part := file.read(step):
            *whole, rest = (rest + part).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1
        if rest:
            yield at, rest


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AppendLogs)


def availability(posts: DataFrame, collectors: DataFrame) -> DataFrame:
    """posts with collectable and reason, from collectors (platform, usable, reason): a post whose platform
    has no collector says so. collectors has a row a platform; a post without a platform has no collector."""
    c = collectors.select(F.col("platform").alias("c_platform"), "usable", F.col("reason").alias("c_reason"))
    j = posts.join(c, posts["platform"] == F.col("c_platform"), "left")
    reason = F.when(F.col("c_platform").isNull(), "no collector for this platform").when(~F.col("usable"), F.col("c_reason"))
    return j.select(*(posts[x] for x in posts.columns), F.coalesce("usable", F.lit(False)).alias("collectable"), reason.alias("reason"))
