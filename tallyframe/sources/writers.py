"""Writing: upserts, append logs, exports, request logs and small text reports."""

from __future__ import annotations

import html
import json
import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.store import upsert
from .readers import current_version, drop_versions, maybe_table, switch_pointer
from .schemas import KEYS


def write_text(path: str | Path, text: str) -> None:
    """A small local file in one step: readers see the old text or the new."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def write_json(path: str | Path, value: object) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert_table(incoming: DataFrame, path: str, name: str, order: str, seen: Observation | None = None) -> None:
    """Merges rows into a store table, which is a folder of versions and a pointer to one of them.

    The merged table is written as a new version; then a pointer file with its name takes the old one's
    place in one rename, so a reader has the old version or the new, never none. The version before it
    stays for readers that have begun; older ones go. A call that ends early leaves a version that
    nothing points to. seen: counts the incoming rows of this very write.
    """
    spark = incoming.sparkSession
    rows = incoming.observe(seen, F.count("*").alias("rows")) if seen is not None else incoming
    merged = upsert(maybe_table(spark, path, name), rows, KEYS[name], order)
    before, version = current_version(spark, path), f"v-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{version}")
    switch_pointer(spark, path, version)
    drop_versions(spark, path, keep={version, before})


def observed_rows(seen: Observation) -> int:
    """What an observed write has counted; 0 where Spark has dropped an empty input from the plan, whose
    observation then holds no metrics at all."""
    try:
        return seen.get["rows"]
    except Py4JJavaError as e:
        if "toPyRow" in str(e):
            return 0
        raise


def record_run(tables: dict[str, tuple[DataFrame, str]], folder: str) -> dict[str, int]:
    """Upserts several tables, each with its order column, and counts what came in: by observing the
    writes, so each input is worked out once."""
    counts = {}
    for name, (rows, order) in tables.items():
        seen = Observation(f"incoming {name}")
        upsert_table(rows, f"{folder}/{name}", name, order, seen)
        counts[name] = observed_rows(seen)
    return counts


def write_csv(rows: DataFrame, path: str) -> bool:
    """CSV with a header; nothing at all for no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def _few(rows: DataFrame, most: int) -> list:
    """The rows of a small result; more than `most` is an error, not a shorter report."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows: aggregate it, or allow more")
    return found


def markdown(rows: DataFrame, most: int = 10_000) -> str:
    """A small result as a table."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|")
    lines = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns), *(" | ".join(map(cell, r)) for r in _few(rows, most))]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def scorecard(scores: DataFrame, width: int = 20) -> str:
    """The best segment's criteria as bars: scores (segment_id, total, criterion, score)."""
    best = scores.orderBy(F.desc("total"), "segment_id").limit(1).select("segment_id", "total")
    rows = scores.join(F.broadcast(best.select("segment_id")), "segment_id").orderBy("criterion").select("segment_id", "total", "criterion", "score", F.rpad(F.repeat(F.lit("#"), F.round(F.col("score") / 10 * width).cast("int")), width, ".").alias("bar")).collect()
    return "\n".join([f"{rows[0].segment_id}  {rows[0].total:.1f}", *(f"{r.criterion:<18} {r.bar} {r.score:4.1f}" for r in rows)]) if rows else ""


def report_html(title: str, sections: dict[str, DataFrame], curve: list[tuple[float, float]] | None = None, most: int = 10_000) -> str:
    """A page of small results, with an optional curve of (0..1, 0..1) drawn inline."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in _few(df, most))
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    if curve:
        points = " ".join(f"{300 * x:.1f},{100 - 100 * y:.1f}" for x, y in curve)
        parts.append(f'<svg viewBox="0 0 300 100"><polyline fill="none" stroke="black" points="{points}"/></svg>')
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title>' + "".join(parts)


def request_log(calls: DataFrame, path: str) -> None:
    """Planned calls as JSON and as commands to read: nothing is sent. calls (post_id, seq, method, url, body)."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    curl = F.concat_ws(" ", F.lit("curl -X"), "method", quote(F.col("url")), F.lit("-d"), quote(F.coalesce("body", F.lit(""))))
    calls.withColumn("curl", curl).sortWithinPartitions("post_id", "seq").write.mode("overwrite").json(path)
