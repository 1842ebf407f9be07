"""Recency-weighted priors by hook type, with a seeded draw from each posterior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of decay, shrinkage, strength, bounds and posterior width without evidence.
TAU, K, ETA, BOUNDS, SIGMA0 = 90.0, 8.0, 0.35, (0.80, 1.25), 0.6


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def gauss(seed: Column) -> Column:
    """A standard normal number from the seed's sha256: Box-Muller on its first two 32-bit parts."""
    digest = F.sha2(seed.cast("binary"), 256)
    u = [F.conv(F.substring(digest, i, 8), 16, 10).cast("double") / 2**32 for i in (1, 9)]
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(F.lit(1e-12), u[0]))) * F.cos(2 * F.pi() * u[1])


def hook_priors(outcomes: DataFrame, hook_types: DataFrame, seed: str = "", tau: float = TAU, k: float = K, eta: float = ETA, bounds=BOUNDS, sigma0: float = SIGMA0, thompson_cold: bool = False) -> DataFrame:
    """outcomes (hook_type, hqs, age_days) that may teach -> a row for each of hook_types.

    Without evidence the mean multiplier is 1, and so is the drawn one unless thompson_cold.
    """
    w = F.exp(-F.col("age_days") / tau)
    g = outcomes.groupBy(F.col("hook_type").alias("_h")).agg(F.sum(w).alias("n"), F.sum(w * F.col("hqs")).alias("s"))
    j = hook_types.select("hook_type").distinct().join(g, F.col("hook_type") == F.col("_h"), "left").select("hook_type", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    j = j.withColumn("y_bar", F.when(F.col("n") > 0, F.col("s") / F.nullif("n", F.lit(0.0))).otherwise(0.0)).withColumn("y_hat", F.col("n") / (F.col("n") + k) * F.col("y_bar")).withColumn("sigma", F.lit(sigma0) / F.sqrt(F.col("n") + 1))
    draw = F.col("y_hat") + F.col("sigma") * gauss(F.concat(F.lit(f"{seed}|"), F.col("hook_type")))
    sampled = clip(F.exp(eta * draw), *bounds)
    if not thompson_cold:
        sampled = F.when(F.col("n") > 0, sampled).otherwise(1.0)
    return j.select("hook_type", F.round("n", 3).alias("n_eff"), F.round("y_bar", 4).alias("y_bar"), F.round("y_hat", 4).alias("y_hat"), F.round("sigma", 4).alias("sigma"), F.round(clip(F.exp(eta * F.col("y_hat")), *bounds), 4).alias("multiplier"), F.round(sampled, 4).alias("sampled_multiplier"))
