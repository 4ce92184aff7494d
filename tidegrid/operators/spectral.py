"""Spectra of weekly series, per site, by FFT within a grouped map; a site's series is bounded by the lattice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The series of the mean over all sites.
ALL_SITES = "All Sites"


def _segments(x: np.ndarray, size: int, step: int) -> np.ndarray:
    starts = range(0, len(x) - size + 1, step)
    parts = np.stack([x[s : s + size] for s in starts])
    return parts - parts.mean(axis=1, keepdims=True)


def _densities(x: np.ndarray, window: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power densities of the detrended segments, one row each."""
    n = len(window)
    spectra = np.fft.rfft(_segments(x, n, step) * window, axis=1)
    power = np.abs(spectra) ** 2 / np.sum(window**2)
    power[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n), power


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _tukey(n: int, share: float = 0.25) -> np.ndarray:
    """Flat with cosine ends; periodic."""
    at = np.arange(n) / n
    ends = np.minimum(at, 1 - at) / (share / 2)
    return np.where(ends < 1, 0.5 - 0.5 * np.cos(np.pi * np.minimum(ends, 1)), 1.0)


def welch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean density of half-overlapping Hann segments, without the constant part; empty below 20 values."""
    if len(x) < 20:
        return np.empty(0), np.empty(0)
    size = max(min(256, len(x) // 4), 4)
    f, p = _densities(x, _hann(size), size - size // 2)
    return f[1:], p.mean(axis=0)[1:]


def periodogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(x) < 2:
        return np.empty(0), np.empty(0)
    f, p = _densities(x, np.ones(len(x)), len(x))
    return f[1:], p[0, 1:]


def spectrogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and log10 densities by segment; empty below 32 values."""
    if len(x) < 32:
        return np.empty(0), np.empty((0, 0))
    size = min(32, len(x) // 4)
    f, p = _densities(x, _tukey(size), size - size // 2)
    return f, np.log10(p + 1e-10)


def coherence(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared magnitude of the cross spectrum by both spectra, over the common length."""
    n = min(len(x), len(y))
    if n < 20:
        return np.empty(0), np.empty(0)
    size = max(min(256, n // 4), 4)
    window, step = _hann(size), size - size // 2
    a, b = (np.fft.rfft(_segments(v[:n], size, step) * window, axis=1) for v in (x, y))
    cross = np.abs((np.conj(a) * b).mean(axis=0)) ** 2
    powers = (np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0)
    return np.fft.rfftfreq(size)[1:], np.divide(cross, powers, out=np.zeros_like(cross), where=powers > 0)[1:]


_KINDS = {"welch": welch, "periodogram": periodogram}


def spectra(df: DataFrame, kind: str, value: str = "value", day: str = "week") -> DataFrame:
    """(site, frequency, period_weeks, power) of each site's series in order; NULL values count as 0."""
    estimate = _KINDS[kind]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = estimate(pdf.sort_values("d")["v"].fillna(0.0).to_numpy())
        return pd.DataFrame({"site": pdf["site"].iloc[0], "frequency": f, "period_weeks": 1 / f, "power": p})

    rows = df.select("site", F.col(day).alias("d"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("site").applyInPandas(one, "site string, frequency double, period_weeks double, power double")


def spectrograms(df: DataFrame, value: str = "value", day: str = "week") -> DataFrame:
    """(site, segment, frequency, log_power)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = spectrogram(pdf.sort_values("d")["v"].fillna(0.0).to_numpy())
        segments, bins = p.shape
        return pd.DataFrame({
            "site": pdf["site"].iloc[0], "segment": np.repeat(np.arange(segments), bins).astype("int32"),
            "frequency": np.tile(f, segments), "log_power": p.ravel(),
        })

    rows = df.select("site", F.col(day).alias("d"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("site").applyInPandas(one, "site string, segment int, frequency double, log_power double")


def coherences(df: DataFrame, first: str, second: str, order: Sequence[str] = ("week",)) -> DataFrame:
    """(site, frequency, coherence) of two series of each site in order; rows with a NULL in either left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        f, c = coherence(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"site": pdf["site"].iloc[0] if len(pdf) else None, "frequency": f, "coherence": c})

    rows = df.select("site", F.struct(*order).alias("o"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).dropna(subset=["a", "b"])
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("o"))).drop("o")
    return placed.groupBy("site").applyInPandas(one, "site string, frequency double, coherence double")


def dominant_periods(spectrum: DataFrame, k: int = 3) -> DataFrame:
    """(site, periods): the periods of the k bins of greatest power, greatest first; at equal power the longer period."""
    nth = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("power"), F.desc("period_weeks")))
    best = spectrum.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("nth", "period_weeks"))).alias("p"))
    return best.select("site", F.col("p.period_weeks").alias("periods"))


def with_all_sites(df: DataFrame, value: str = "value", day: str = "week", name: str = ALL_SITES) -> DataFrame:
    """(site, day, value) of every site and, under ``name``, of the mean over the sites."""
    mean = df.groupBy(day).agg(F.avg(value).alias(value)).select(F.lit(name).alias("site"), day, value)
    return df.select("site", day, value).unionByName(mean)


def spectral_summary(series: DataFrame, spectrum: DataFrame, value: str = "value") -> DataFrame:
    """(site, n, mean, std, total_power): the series and the power of its spectrum; the deviation is that of the population."""
    values = series.groupBy("site").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return values.join(spectrum.groupBy("site").agg(F.sum("power").alias("total_power")), "site")
