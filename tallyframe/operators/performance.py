"""Post performance: normalised scores, shrunk rankings, gap drivers, paired lifts and provenance shares.

Everything is grouped or windowed by keys; group means combine before their shuffle. Frames that
reach the driver's side of a plan (rankings, verdicts) have a row per hook type or test group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The composite's weights, the shrinkage count and the least material lift.
WEIGHTS = {"hook_retention_3s": 0.45, "completion_rate": 0.25, "engagement_rate": 0.20, "ctr": 0.10}
SHRINKAGE, MATERIAL_LIFT, TEACHING = 5.0, 0.05, 0.60


def zscores(rows: DataFrame, by: str = "platform", metrics=tuple(WEIGHTS)) -> DataFrame:
    """z_<metric> of each row among its group, sample deviation; 0 for a lone row or a flat group.

    The group's moments are one small aggregate joined back, so a group that holds most rows is
    never sorted or gathered in one task.
    """
    moments = [f(F.col(m)).alias(f"_{k}_{m}") for m in metrics for k, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    stats = rows.groupBy(F.col(by).alias("_by")).agg(*moments)

    def z(m: str) -> Column:
        mean, sd = F.col(f"_mean_{m}"), F.coalesce(f"_sd_{m}", F.lit(0.0))
        return F.when(sd <= 1e-12 * F.abs(mean), 0.0).otherwise((F.col(m) - mean) / sd)

    joined = rows.join(stats, F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*(rows[c] for c in rows.columns), *(F.coalesce(z(m), F.lit(0.0)).alias(f"z_{m}") for m in metrics))


def composite(rows: DataFrame, weights=None) -> DataFrame:
    """Adds hqs, the weighted sum of the z-scores."""
    weights = weights or WEIGHTS
    return rows.withColumn("hqs", sum((F.lit(w) * F.col(f"z_{m}") for m, w in weights.items()), F.lit(0.0)))


def shrunk_ranking(scored: DataFrame, by: str = "hook_type", k: float = SHRINKAGE, digits: int = 4) -> DataFrame:
    """n, hqs_mean, hqs_shrunk = n * mean / (n + k) and rank on the rounded value, ties by name."""
    g = scored.groupBy(by).agg(F.count("*").alias("n"), F.avg("hqs").alias("m"))
    g = g.select(by, "n", F.round("m", digits).alias("hqs_mean"), F.round(F.col("n") * F.col("m") / (F.col("n") + k), digits).alias("hqs_shrunk"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hqs_shrunk"), by)))


def gap_drivers(scored: DataFrame, ranking: DataFrame, weights=None) -> DataFrame:
    """How much of the gap between the first and the last of the ranking each metric explains."""
    weights = weights or WEIGHTS
    means = scored.groupBy("hook_type").agg(*(F.avg(f"z_{m}").alias(m) for m in weights))
    ends = ranking.agg(F.min_by("hook_type", "rank").alias("winner"), F.max_by("hook_type", "rank").alias("loser"))
    joined = means.crossJoin(F.broadcast(ends))  # one row
    side = joined.agg(*(F.max(F.when(F.col("hook_type") == F.col(w), F.col(m))).alias(f"{w}_{m}") for m in weights for w in ("winner", "loser")))
    long = side.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"winner_{m}").alias("w"), F.col(f"loser_{m}").alias("l"), F.lit(v).alias("weight")) for m, v in weights.items()))).alias("x")).select("x.*")
    long = long.withColumn("c", F.col("weight") * (F.col("w") - F.col("l")))
    positive = F.sum(F.when(F.col("c") > 0, F.col("c"))).over(Window.partitionBy(F.lit(0)))  # four rows
    share = F.when((F.col("c") > 0) & (positive > 0), F.round(F.col("c") / positive, 4)).otherwise(0.0)
    return long.select("metric", F.round("w", 3).alias("winner_z"), F.round("l", 3).alias("loser_z"), F.round("c", 4).alias("contribution"), share.alias("share"))


def half_up(c: Column, digits: int) -> Column:
    """Rounded by a floor, the same in every engine and never a negative zero."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def exact_mean(c: Column, when: Column | None = None, digits: int = 9) -> Column:
    """The mean of values of so many digits, summed as decimals: the same in any order of the rows."""
    c = F.when(when, c) if when is not None else c
    return F.sum(c.cast(f"decimal(28,{digits})")).cast("double") / F.nullif(F.count(c), F.lit(0))


def ab_lifts(rows: DataFrame, weights=None) -> DataFrame:
    """For each test group and platform with both sides: relative lift of B over A by metric, 0 where
    A is not positive, and their weighted composite rounded to 4. Sums are exact, so that no rounding
    depends on the order of the rows."""
    weights = weights or WEIGHTS
    means = [exact_mean(F.col(m), F.col("variant") == v).alias(f"{v}_{m}") for m in weights for v in "AB"]
    sides = [F.count_if(F.col("variant") == v).alias(f"n_{v.lower()}") for v in "AB"]
    both = rows.where(F.col("ab_group").isNotNull()).groupBy("ab_group", "platform").agg(*means, *sides).where("n_a > 0 and n_b > 0")

    def lift(m: str) -> Column:
        a, b = F.col(f"A_{m}"), F.col(f"B_{m}")
        return F.when(a > 0, (b - a) / F.nullif(a, F.lit(0.0)) + 0.0).otherwise(0.0)

    undefined = sum((F.when(F.col(f"A_{m}") > 0, 0).otherwise(1) for m in weights), F.lit(0))
    total = sum((F.lit(w) * lift(m) for m, w in weights.items()), F.lit(0.0))
    return both.select("ab_group", "platform", "n_a", "n_b", *(lift(m).alias(f"lift_{m}") for m in weights), half_up(total, 4).alias("composite_lift"), undefined.alias("undefined"))


def ab_verdicts(lifts: DataFrame, material: float = MATERIAL_LIFT) -> DataFrame:
    """A winner only where the mean lift is material and every shared platform agrees in direction."""
    sign = F.signum("composite_lift")
    g = lifts.groupBy("ab_group").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("platforms"), exact_mean(F.col("composite_lift")).alias("m"),
        F.count_if(sign > 0).alias("up"), F.count_if(sign < 0).alias("down"),
    )
    agreeing = F.when(F.col("m") > 0, F.col("up")).when(F.col("m") < 0, F.col("down")).otherwise(F.lit(0).cast("long"))
    g = g.withColumn("platforms_agreeing", agreeing).withColumn("material", F.abs("m") >= material)
    winner = F.when(F.col("material") & (F.col("platforms_agreeing") == F.col("platforms")), F.when(F.col("m") > 0, "B").otherwise("A"))
    return g.select("ab_group", "n_a", "n_b", "platforms", half_up(F.col("m"), 4).alias("mean_lift"), F.col("m").alias("exact_lift"), "platforms_agreeing", "material", winner.alias("winner"))


def real_fraction(detail: Column, fields=tuple(WEIGHTS)) -> Column:
    """Share of the fields whose provenance is REAL."""
    return sum((F.when(F.coalesce(F.try_element_at(detail, F.lit(f)), F.lit("")) == "REAL", 1.0).otherwise(0.0) for f in fields), F.lit(0.0)) / len(fields)


def real_weight(detail: Column, weights=None) -> Column:
    """Weight of the composite that came from REAL fields."""
    weights = weights or WEIGHTS
    return sum((F.when(F.coalesce(F.try_element_at(detail, F.lit(f)), F.lit("")) == "REAL", w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))


def row_provenance(detail: Column) -> Column:
    """REAL or SIMULATED where all fields are, else MIXED; MIXED for an empty map."""
    kinds = F.array_distinct(F.map_values(detail))
    return F.when(F.size(kinds) == 1, F.when(kinds[0].isin("REAL", "SIMULATED"), kinds[0]).otherwise("MIXED")).otherwise("MIXED")


def first_wins(a: Column, b: Column) -> Column:
    """Two maps in one; a key in both keeps the first map's value."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y))


#: The rubric's criteria with their weights, of 100 together, and how each is judged.
RUBRIC = {
    "energy": (8, "deterministic"), "pitch_variance": (6, "deterministic"), "speech_rate": (5, "deterministic"), "numeric_density": (7, "deterministic"), "question_density": (6, "deterministic"), "turn_taking": (5, "deterministic"),
    "self_contained": (8, "deterministic"), "hook_3s": (14, "llm"), "curiosity_gap": (12, "llm"), "emotional_charge": (10, "llm"), "standalone": (11, "llm"), "audience_fit": (8, "llm"),
}
#: Fixed value: the score of a criterion that could not be judged.
NEUTRAL = 5.0


def rubric_rows(scores: DataFrame, key: str) -> DataFrame:
    """(key, criterion, method, weight, score, points, judged): a row for each criterion of RUBRIC of each row of
    scores, which has a column a criterion, 0 to 10. A null counts as NEUTRAL and is not judged; points
    are score / 10 * weight."""
    long = scores.select(key, *(F.col(c).cast("double").alias(c) for c in RUBRIC)).unpivot([key], list(RUBRIC), "criterion", "raw")
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for c, v in RUBRIC.items() for x in (c, v[i]))), F.col("criterion"))
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("raw", F.lit(NEUTRAL))))
    r = long.select(key, "criterion", of(1).alias("method"), of(0).alias("weight"), score.alias("score"), F.col("raw").isNotNull().alias("judged"))
    return r.withColumn("points", F.col("score") / 10.0 * F.col("weight"))


def rubric_totals(rows: DataFrame, key: str) -> DataFrame:
    """(key, base, deterministic, llm, unjudged): a key's points, in all and by method, summed as decimals,
    and how many criteria were not judged."""
    exact = F.col("points").cast("decimal(20,9)")
    of = lambda m: F.coalesce(F.sum(F.when(F.col("method") == m, exact)), F.lit(0)).cast("double").alias(m)
    return rows.groupBy(key).agg(F.sum(exact).cast("double").alias("base"), of("deterministic"), of("llm"), F.count_if(~F.col("judged")).alias("unjudged"))
