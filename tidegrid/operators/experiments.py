"""Diagnostics and comparisons of runs: autocorrelation, transitions, stability, sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.classes import SPIKE
from tidegrid.operators.joins import asof_join


def autocorrelation(df: DataFrame, value: str, day: str) -> DataFrame:
    """(site, n, rho, rho2, mean, std, pct_positive) of each site's series in order; rho needs 4 values."""
    pairs = df.select("site", F.col(value).alias("x"), F.lag(value).over(Window.partitionBy("site").orderBy(day)).alias("y"))
    rho = F.when(F.count("*") >= 4, F.corr("x", "y"))
    return pairs.groupBy("site").agg(
        F.count("*").alias("n"), rho.alias("rho"), (rho * rho).alias("rho2"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        (F.avg((F.col("x") > 0).cast("int")) * 100).alias("pct_positive"),
    )


def previous_observation(df: DataFrame, order: Sequence[str], value: str, day: str) -> DataFrame:
    """Adds the site's previous value and the days since.

    The site's rows are cut by year; the first of a year looks back through one row per site and year.
    """
    by_year = df.withColumn("_y", F.year(day))
    here = Window.partitionBy("site", "_y").orderBy(*order)
    packed = F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"), F.col(day).alias("d"))
    ends = by_year.groupBy("site", "_y").agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    handed = ends.select("site", "_y", F.lag("_end").over(Window.partitionBy("site").orderBy("_y")).alias("_carry"))
    met = by_year.withColumn("_last", F.lag(packed).over(here)).join(handed, ["site", "_y"], "left")
    last = F.coalesce("_last", "_carry")
    return met.withColumn("_b", last).select(*df.columns, F.col("_b.v").alias("previous"), F.datediff(F.col(day), F.col("_b.d")).alias("gap_days"))


def transitions(results: DataFrame, raw: DataFrame, threshold: float = SPIKE) -> DataFrame:
    """The results with the previous measurement and whether the actual one crosses the threshold upward."""
    before = raw.groupBy("site", F.col("date").alias("_d0")).agg(F.max("da_raw").alias("previous"))
    met = asof_join(results, before, by=["site"], left_on="date", right_on="_d0", payload=["previous"], strict=True)
    crossed = F.coalesce((F.col("previous") < threshold) & (F.col("actual") >= threshold), F.lit(False))
    return met.drop("matched_on").withColumns({"is_transition": crossed, "is_actual_spike": F.col("actual") >= threshold, "is_non_spike": F.col("actual") < threshold})


#: The score of all sites together.
POOLED = "pooled"


def seeded_scores(weekly: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(site, seed, mae): the error of persistence on the half of the weeks that each seed draws by hash; also of all sites, POOLED."""
    p = F.lag("da_raw").over(Window.partitionBy("site").orderBy("week"))
    rows = weekly.select("site", "week", "da_raw", p.alias("p")).where("p IS NOT NULL")
    drawn = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    key = F.md5(F.concat_ws("|", "site", F.col("week").cast("string"), F.col("seed").cast("string")))
    scores = drawn.where(key < "8").groupingSets([["site", "seed"], ["seed"]], "site", "seed").agg(F.avg(F.abs(F.col("da_raw") - F.col("p"))).alias("mae"))
    return scores.withColumn("site", F.coalesce("site", F.lit(POOLED)))


def stability(scores: DataFrame, bound: float) -> DataFrame:
    """(site, seeds, mean, noise, always_above, always_below): spread of a score over seeds, and whether it always lies on one side of a bound."""
    return scores.groupBy("site").agg(
        F.count("*").alias("seeds"), F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("noise"),
        F.bool_and(F.col("mae") > bound).alias("always_above"), F.bool_and(F.col("mae") < bound).alias("always_below"),
    )


def noise_floor(scores: DataFrame) -> DataFrame:
    """(site, on_mean, on_std, off_mean, off_std, delta_mean, delta_std, all_positive, all_negative) of seeded runs.

    ``scores`` is (experiment, site, r2, ...) with experiments ``seedN_site`` and ``seedN_global``, runs of a
    seed with and without settings of single sites; a NULL site is the total and comes out as POOLED. Deviations
    are those of the population; seeds that lack a run have no delta.
    """
    seed, kind = F.regexp_extract("experiment", r"^(seed.*)_(site|global)$", 1), F.regexp_extract("experiment", r"^(seed.*)_(site|global)$", 2)
    pick = lambda name: F.max(F.when(F.col("kind") == name, F.col("r2")))
    runs = scores.select(F.coalesce("site", F.lit(POOLED)).alias("site"), seed.alias("seed"), kind.alias("kind"), "r2").where("kind <> ''")
    paired = runs.groupBy("site", "seed").agg(pick("site").alias("on"), pick("global").alias("off")).withColumn("delta", F.col("on") - F.col("off"))
    columns = [f(c).alias(f"{c}_{n}") for c in ("on", "off", "delta") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return paired.groupBy("site").agg(*columns, F.bool_and(F.col("delta") > 0).alias("all_positive"), F.bool_and(F.col("delta") < 0).alias("all_negative"))


def significance(scores: DataFrame, noise: float | None, baseline: str = "baseline") -> DataFrame:
    """(experiment, site, r2, mae, delta_r2, threshold, significant, verdict) of runs against the baseline of their site.

    A change of R2 counts if it exceeds twice the noise of the seeds, or 0.02 where no noise is known. The
    verdict of a run that is better beyond that is ``keep``, of one within it ``blend?``, else ``unstable``.
    """
    threshold = 2.0 * noise if noise else 0.02
    named = scores.withColumn("site", F.coalesce("site", F.lit(POOLED)))
    base = named.where(F.col("experiment") == baseline).select("site", F.col("r2").alias("base"))
    delta = F.col("r2") - F.col("base")
    met = named.where(F.col("experiment") != baseline).join(base, "site").withColumns({"delta_r2": delta, "threshold": F.lit(threshold)})
    met = met.withColumn("significant", F.abs("delta_r2") > F.col("threshold"))
    verdict = F.when(F.col("delta_r2") > F.col("threshold"), "keep").when(~F.col("significant"), "blend?").otherwise("unstable")
    return met.select("experiment", "site", "r2", "mae", "delta_r2", "threshold", "significant", verdict.alias("verdict"))


def recommendations(judged: DataFrame, floor: DataFrame) -> DataFrame:
    """(subject, name): what the runs suggest to look into, perturbations that count overall and sites whose gain changes its sign with the seed."""
    moved = judged.where((F.col("site") == POOLED) & F.col("significant")).select(F.lit("sensitive").alias("subject"), F.col("experiment").alias("name"))
    swaying = floor.where((F.col("site") != POOLED) & ~F.col("all_positive") & ~F.col("all_negative")).select(F.lit("unstable").alias("subject"), F.col("site").alias("name"))
    return moved.unionByName(swaying)


def against_baseline(scores: DataFrame, name: str, baseline: str, metric: str) -> DataFrame:
    """Adds ``delta`` to the baseline's score and a verdict; the scores are one row per experiment."""
    base = F.max(F.when(F.col(name) == baseline, F.col(metric))).over(Window.partitionBy(F.lit(0)))
    moved = scores.withColumn("delta", F.col(metric) - base)
    return moved.withColumn("verdict", F.when(F.col("delta") > 1, "keep").when(F.col("delta") > 0, "blend?").otherwise("baseline"))


def linear_sensitivity(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, slope, permutation, first_order) of the least-squares plane, in closed form.

    ``permutation`` is the expected loss of R2 when a feature is shuffled, 2 b^2 var(x) / var(y);
    ``first_order`` its share of the variance over independent uniform inputs, b^2 r^2 / sum. One
    aggregate gives all moments; only these reach the driver.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    known = df.dropna(subset=[target, *features])
    row = known.agg(
        F.var_pop(target), *[F.covar_pop(a, b) for a, b in pairs], *[F.covar_pop(a, target) for a in features], *[F.max(a) - F.min(a) for a in features], F.count("*")
    ).first()
    k = len(features)
    if not row[-1]:
        return df.sparkSession.createDataFrame([], "feature string, slope double, permutation double, first_order double")
    covariance = np.zeros((k, k))
    for (a, b), v in zip(pairs, row[1:]):
        i, j = features.index(a), features.index(b)
        covariance[i, j] = covariance[j, i] = v
    at = 1 + len(pairs)
    slopes = np.linalg.lstsq(covariance, np.array(row[at : at + k], float), rcond=None)[0]
    ranges = np.array(row[at + k : at + 2 * k], float)
    shares = (slopes * ranges) ** 2
    total = shares.sum() or 1.0
    rows = [
        (f, float(b), float(2 * b * b * covariance[i, i] / row[0]) if row[0] else None, float(s / total))
        for i, (f, b, s) in enumerate(zip(features, slopes, shares))
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, slope double, permutation double, first_order double")
