"""Grouped summaries that are more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import settled


#: Targets of an interpolation that are packed together.
TARGETS = 1_000
#: Distinct values that a quantile looks at on the driver.
CLOSE_VALUES = 10_000


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The mean of the values that aren't NULL per key."""
    return df.groupBy(*keys).agg(settled(F.avg(value)).alias(name))


def iso_week(day: str) -> Column:
    """The ISO year and week as ``2020-53``."""
    week = F.weekofyear(day).cast("string")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), F.col(day)).cast("string"), F.lit("-"), F.lpad(week, 2, "0"))


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence[str], name: str = "{}") -> DataFrame:
    """One column per listed value of ``column`` with the mean of its rows."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(name.format(v).replace("-", "_")) for v in values])


def latest(df: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The payload of each key's last row in order; the order should be unique."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_last"))
    return best.select(key, *[F.col(f"_last.{c}").alias(c) for c in payload])


def numeric_only(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all; one pass counts them."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def exact_quantile(df: DataFrame, value: str, q: float = 0.5) -> float | None:
    """The exact q-quantile, interpolated between neighbours, of the values that aren't NULL; None if there are none.

    No task sorts or holds all values: approximate quantiles bracket the two ranks that are asked for, and
    only the bracket is counted by value, again and again until it has few enough. Each pass is one
    aggregate with map-side sums.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = q * (n - 1)
    first, second = int(place), min(int(place) + 1, n - 1)
    below = 0
    while True:
        inside = values.where(F.col("v").between(low, high))
        counts = inside.groupBy("v").agg(F.count("*").alias("n"))
        if counts.limit(CLOSE_VALUES + 1).count() <= CLOSE_VALUES:
            break
        held = inside.count()
        share = lambda rank: min(max((rank - below) / held, 0.0), 1.0)
        ends = inside.agg(F.percentile_approx("v", [max(share(first) - 1e-3, 0.0), min(share(second) + 1e-3, 1.0)], 10_000)).first()[0]
        before, reached = values.agg(F.count_if(F.col("v") < ends[0]), F.count_if(F.col("v") <= ends[1])).first()
        if not (before <= first and second < reached) or tuple(ends) == (low, high):
            break
        low, high, below = ends[0], ends[1], before
    near, at = {}, below
    for v, count in sorted((r["v"], r["n"]) for r in counts.collect()):
        for rank in (first, second):
            if at <= rank < at + count:
                near[rank] = v
        at += count
    return near[first] + (place - first) * (near[second] - near[first])


def inverse_distance(grid: DataFrame, targets: DataFrame, *, period: str, lat: str, value: str, target: str, target_lat: str, power: float = 2.0) -> DataFrame:
    """(target, period, interpolated): the mean of grid values weighted by 1 / (distance^power + 1e-9).

    Grid values at the target's own latitude, where there are any, are taken alone. The grid of a
    period is packed into one array, as it has few latitudes. Targets are packed in blocks of about
    TARGETS, each of which meets every period by an equi-join on the block, so the result's rows come
    to be where a block and a period meet and no side is collected.
    """
    blocks = max(1, -(-targets.count() // TARGETS))
    block = F.pmod(F.xxhash64(target), F.lit(blocks)).alias("_block")
    packed = targets.where(F.col(target_lat).isNotNull()).select(block, F.struct(F.col(target).alias("s"), F.col(target_lat).cast("double").alias("l")).alias("t"))
    listed = packed.groupBy("_block").agg(F.collect_list("t").alias("_listed"))
    cells = grid.where(F.col(lat).isNotNull() & F.col(value).isNotNull()).groupBy(period).agg(F.collect_list(F.struct(F.col(lat).alias("lat"), F.col(value).alias("v"))).alias("cells"))
    spread = cells.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    periods = spread.join(listed, "_block").select(period, "cells", F.explode("_listed").alias("_t")).select(
        period, "cells", F.col("_t.s").alias(target), F.col("_t.l").alias(target_lat)
    )
    at = F.col(target_lat)
    near = lambda c: F.abs(c["lat"] - at) <= 1e-8 + 1e-5 * F.abs(at)
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda acc, c: acc + f(c))
    exact = F.filter("cells", near)
    weight = lambda c: 1 / (F.pow(F.abs(c["lat"] - at), F.lit(power)) + 1e-9)
    spread = total(F.col("cells"), lambda c: c["v"] * weight(c)) / total(F.col("cells"), weight)
    return periods.select(target, period, F.when(F.size(exact) > 0, total(exact, lambda c: c["v"]) / F.size(exact)).otherwise(spread).alias("interpolated"))


def running_totals_at(points: DataFrame, point: str, totals: DataFrame, at: str, sums: Sequence[str]) -> DataFrame:
    """For each point the sums over all rows of ``totals`` at or before it, by one ordered pass.

    ``totals`` has a row per time, not per event, so the ordered pass is over distinct times.
    """
    marked = totals.select(F.col(at).alias("_at"), *sums, F.lit(False).alias("_point")).unionByName(
        points.select(F.col(point).alias("_at"), *[F.lit(0).cast("long").alias(c) for c in sums], F.lit(True).alias("_point"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    run = marked.select("_at", "_point", *[F.sum(c).over(order).alias(c) for c in sums])
    return run.where(F.col("_point") & (F.col(sums[0]) > 0)).select(F.col("_at").alias(point), *sums)


def correlation_matrix(df: DataFrame) -> DataFrame:
    """(a, b, r): Pearson correlation of every ordered pair of columns over rows where both are given.

    All pairs are computed in one aggregate; the matrix is then unpivoted.
    """
    pairs = list(combinations_with_replacement(df.columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for a, b, i in both])
    return row.select(F.explode(cells).alias("cell")).select("cell.a", "cell.b", "cell.r")


def correlations_by(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(*by, a, b, n, r): Pearson correlation of every pair of columns, a before b, per key and over rows where both are given.

    ``r`` is NULL with fewer than three such rows or where either doesn't vary. All pairs take one aggregate.
    """
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            varies = (F.count(x) >= 3) & (F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12)
            r = F.when(varies, F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), r.alias("r")))
    return df.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.explode("cells").alias("c")).select(*by, "c.*")


def matrix_to_long(matrix: DataFrame, name: str, variable: str = "b", value: str = "r") -> DataFrame:
    """A square table with a row and a column per name as (name, variable, value)."""
    return matrix.unpivot([name], [c for c in matrix.columns if c != name], variable, value)


def target_correlation(df: DataFrame, target: str, k: int) -> DataFrame:
    """(feature, r): the k columns of greatest absolute correlation with the target."""
    matrix = correlation_matrix(df).where((F.col("b") == target) & (F.col("a") != target))
    return matrix.select(F.col("a").alias("feature"), F.abs("r").alias("r")).orderBy(F.desc("r"), "feature").limit(k)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes x rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def map_means(df: DataFrame, column: str) -> DataFrame:
    """(key, mean_present, mean_zero_filled) of a map column's values over rows."""
    rows = df.select(F.explode_outer(column).alias("key", "value"), F.lit(1).alias("one"))
    n = df.count()
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.avg("value").alias("mean_present"), (F.sum("value") / F.lit(n)).alias("mean_zero_filled"))


def map_matrix(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, <row key>, value) of the k map keys of the largest mean."""
    cells = df.select(F.col(key), F.explode(column).alias("key", "value"))
    top = cells.groupBy("key").agg(F.avg("value").alias("m")).orderBy(F.desc("m"), "key").limit(k).select("key")
    return cells.join(top, "key")


def min_max(df: DataFrame, value: str, group: str, cap: float | None = None) -> DataFrame:
    """Adds ``scaled``: the capped value between the group's least (0) and greatest (1); constant groups are 0."""
    capped = F.least(F.col(value), F.lit(cap)) if cap is not None else F.col(value)
    bounds = df.groupBy(group).agg(F.min(capped).alias("_lo"), F.max(capped).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (capped - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(bounds, group).withColumn("scaled", F.when(F.col(value).isNotNull(), scaled).otherwise(0.0)).drop("_lo", "_hi")


def gradient_band(df: DataFrame, segments: int) -> DataFrame:
    """Each (q50, lo, hi) as segments with the opacity 1 - sqrt(distance from q50 / the farthest), within 0.1 and 0.9."""
    flat = F.col("hi") <= F.col("lo")
    lo, hi = F.when(flat, F.col("q50") - 1).otherwise(F.col("lo")), F.when(flat, F.col("q50") + 1).otherwise(F.col("hi"))
    cut = df.withColumns({"lo": lo, "hi": hi}).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    mid = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("segment") + 0.5) / segments
    far = F.greatest(F.col("q50") - F.col("lo"), F.col("hi") - F.col("q50"))
    return cut.withColumn("mid", mid).withColumn("opacity", F.least(F.greatest(1 - F.sqrt(F.abs(F.col("mid") - F.col("q50")) / far), F.lit(0.1)), F.lit(0.9)))
