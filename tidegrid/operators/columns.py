"""Operators on the set of columns: coercion, alignment, renaming, per-site subsets, keyword resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import EngineConfig


def coerce_numbers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All columns but the keys as doubles; what is no number, or not a finite one, is NULL."""
    def number(c: str) -> Column:
        v = F.col(c).cast("string").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias(c)

    return df.select(*keys, *[number(c) for c in df.columns if c not in keys])


def align(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Exactly these columns in this order, absent ones and NULLs as the default."""
    return df.select(*[F.coalesce(F.col(c), F.lit(default)).alias(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns by an explicit map, never by position; absent ones are an error."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def resolve(columns: Sequence[str], keywords: Sequence[str]) -> str | None:
    """The first column whose name holds all keywords, in any case."""
    return next((c for c in columns if all(k.lower() in c.lower() for k in keywords)), None)


def site_settings(sites: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each site with its blend weights and bounds, the defaults where it has none of its own."""
    own = [(n, s.boosted_weight, s.forest_weight, s.clip_quantile, s.cap) for n, s in config.sites.items()] if config.per_site else []
    known = sites.sparkSession.createDataFrame(own, "site string, _b double, _f double, clip_quantile double, cap double")
    base = config.site("")
    joined = sites.join(known, "site", "left")
    return joined.withColumns({"boosted_weight": F.coalesce("_b", F.lit(base.boosted_weight)), "forest_weight": F.coalesce("_f", F.lit(base.forest_weight))}).drop("_b", "_f")


def keep_site_features(df: DataFrame, features: str, subsets: Mapping[str, Sequence[str]]) -> DataFrame:
    """The map column cut to the subset of the row's site; sites without a subset keep all."""
    if not subsets:
        return df
    table = F.create_map(*[x for s, names in subsets.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))])
    wanted = F.try_element_at(table, F.col("site"))
    return df.withColumn(features, F.when(wanted.isNull(), F.col(features)).otherwise(F.map_filter(features, lambda k, _: F.array_contains(wanted, k))))


def latest_by_variable(df: DataFrame, day: str, variables: Sequence[str]) -> DataFrame:
    """Each variable's last value that isn't NULL, up to the row's day, variable by variable."""
    so_far = Window.partitionBy("site").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(so_far) for v in variables})


def close_to(a: Column, b: Column) -> Column:
    """Equality of doubles up to 1e-8 and a relative 1e-5."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def sorted_entries(column: str) -> Column:
    """The entries of a map as an array, the largest value first, at equal values by key."""
    entries = F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("value")))
