"""Reading JSON that is nearly right: envelopes, fences, prose around it, trailing commas, inner quotes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Curly quotes and what they stand for.
QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'"})
#: Patterns of a comma before a closing bracket, and of names that are no JSON.
TRAILING, FOREIGN = r",\s*([}\]])", r"\bNaN\b|\bNone\b"
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def outer_block(text: str) -> str | None:
    """The first balanced object or array, brackets in strings aside."""
    blank = STRING.sub(lambda m: " " * len(m[0]), text)
    start = re.search(r"[{\[]", blank)
    if not start:
        return None
    pair, depth = ("{}" if start[0] == "{" else "[]"), 0
    for m in re.finditer(f"[{re.escape(pair)}]", blank[start.start() :]):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return text[start.start() : start.start() + m.end()]
    return None


def quoted_inside(text: str) -> str:
    """Escapes quotes within strings: a quote closes a string only before , : } ] or the end."""
    parts = re.split(r'(?<!\\)"', text)
    out, open_ = parts[0], False
    for i, part in enumerate(parts[1:], 1):
        closes = open_ and (part.lstrip()[:1] in (",", ":", "}", "]") or (not part.strip() and i == len(parts) - 1))
        out += ('"' if closes or not open_ else '\\"') + part
        open_ = not closes if open_ else True
    return out


def repaired(text: str | None) -> str | None:
    """Valid JSON text, by the mildest repair that gives some; None if none does."""
    if text is None:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    for step in (lambda t: t, lambda t: outer_block(t) or t, lambda t: re.sub(FOREIGN, "null", re.sub(TRAILING, r"\1", t.translate(QUOTES))), quoted_inside):
        bare = step(bare)
        if _parses(bare):
            return bare
    return None


@F.pandas_udf(StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(repaired)


def repair_rows(rows: DataFrame, text: str, name: str = "repaired") -> DataFrame:
    """rows with valid JSON text, or null where none can be made of it. Text that Spark parses is only
    trimmed; the others alone go through the repair, in batches."""
    good = F.try_parse_json(text).isNotNull()
    kept = rows.where(good).withColumn(name, F.regexp_replace(text, r"^\s+|\s+$", ""))
    return kept.unionByName(rows.where(~F.coalesce(good, F.lit(False))).withColumn(name, repair_json(text)))


def map_or_empty(c: Column) -> Column:
    """A JSON object of strings as a map; malformed text as an empty one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def unwrapped(c: Column) -> Column:
    """The first text among an envelope's result, content and text fields, else the text itself."""
    return F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in ("result", "content", "text")), c)
