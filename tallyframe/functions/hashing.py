"""Deterministic values from hashes: buckets, jitter, keys, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_mod(text: Column, n: int) -> Column:
    """The sha256 as one whole number, modulo n (n below 2^31), limb by limb."""
    digest = F.sha2(text.cast("binary"), 256)
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(digest.substr(i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(limbs, F.lit(0).cast("long"), lambda acc, x: (acc * F.lit(1 << 32) + x) % n)


def jitter_minutes(text: Column) -> Column:
    """Minutes from -12 to 12, from the text's sha1."""
    return (F.conv(F.substring(F.sha1(text.cast("binary")), 1, 4), 16, 10).cast("int") % 25) - 12


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, 32)


def fingerprint(stage: str, config: dict, depends: list[str], version: str = "v1") -> str:
    """Sixteen hex digits that change with a stage's settings or with anything it depends on."""
    text = json.dumps([stage, version, config, depends], sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:16]
