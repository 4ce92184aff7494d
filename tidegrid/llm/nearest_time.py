"""Matching records by nearest time: a streaming merge of two time-sorted tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import wall_micros

#: An entity's time line is cut into stretches of so many tolerances, but at least a day each.
STRETCH_TOLERANCES = 28

_NEVER = np.iinfo(np.int64).max // 4


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Merge:
    """Both tables as one stream in order of group, time and side; right rows come first at a time.

    Two pointers move along it: the last right record passed and the next one ahead, for the rows of a
    batch by running maxima and minima of positions. Between batches only the last right record is held,
    and apart from the stream the left rows that wait for the next, with the record before them.
    """

    def __init__(self, tolerance_us: int):
        self.tolerance = tolerance_us
        self.group, self.last_key = 0, None
        self.last: tuple[int, int, int] | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _groups(self, batch: pa.RecordBatch) -> np.ndarray:
        entity, stretch = batch.column(0), batch.column(1)
        fresh = np.ones(len(batch), bool)
        if len(batch) > 1:
            other = pc.or_(pc.not_equal(entity.slice(1), entity.slice(0, len(batch) - 1)), pc.not_equal(stretch.slice(1), stretch.slice(0, len(batch) - 1)))
            fresh[1:] = other.to_numpy(zero_copy_only=False)
        fresh[0] = self.last_key != (entity[0].as_py(), stretch[0].as_py())
        self.last_key = (entity[len(batch) - 1].as_py(), stretch[len(batch) - 1].as_py())
        groups = self.group + np.cumsum(fresh)
        self.group = int(groups[-1])
        return groups

    def _choose(self, left: np.ndarray, before: np.ndarray, d_before: np.ndarray, after: np.ndarray, d_after: np.ndarray) -> _Found:
        best, gap = np.where(d_before <= d_after, before, after), np.minimum(d_before, d_after)
        done = gap <= self.tolerance
        return left[done], best[done], gap[done]

    def _release(self, chunks: list, after: int = 0, moment: int | None = None) -> list[_Found]:
        """The waiting rows with the next right record, or without one."""
        found = []
        for left, times, before, d_before in chunks:
            d_after = np.full(len(left), _NEVER) if moment is None else moment - times
            found.append(self._choose(left, before, d_before, np.full(len(left), after), d_after))
        return found

    def push(self, batch: pa.RecordBatch) -> list[_Found]:
        held = self.group
        group, (moment, side, number) = self._groups(batch), (batch.column(i).to_numpy() for i in (2, 3, 4))
        n = len(group)
        place, right = np.arange(n), side == 0
        found = []
        if self.waiting:
            ahead = np.flatnonzero(right & (group == held))
            if len(ahead):
                found += self._release(self.waiting, int(number[ahead[0]]), int(moment[ahead[0]]))
                self.waiting = []
            elif group[-1] != held:
                found += self._release(self.waiting)
                self.waiting = []
            else:
                # no right record can come near enough for those so far back
                late = [times[-1] + self.tolerance < moment[-1] for _, times, _, _ in self.waiting]
                found += self._release([c for c, gone in zip(self.waiting, late) if gone])
                self.waiting = [c for c, gone in zip(self.waiting, late) if not gone]

        # of right records at one time the first, with the smallest id, stands for all
        opens = right.copy()
        opens[1:] &= ~(right[:-1] & (group[1:] == group[:-1]) & (moment[1:] == moment[:-1]))
        passed = np.maximum.accumulate(np.where(opens, place, -1))
        coming = np.minimum.accumulate(np.where(opens, place, n)[::-1])[::-1]
        left = np.flatnonzero(~right)
        before, after = passed[left], coming[left]
        has_before = (before >= 0) & (group[np.maximum(before, 0)] == group[left])
        before_id = number[np.maximum(before, 0)]
        d_before = np.where(has_before, moment[left] - moment[np.maximum(before, 0)], _NEVER)
        if self.last is not None:
            carried = ~has_before & (group[left] == self.last[0])
            before_id = np.where(carried, self.last[2], before_id)
            d_before = np.where(carried, moment[left] - self.last[1], d_before)
        has_after = (after < n) & (group[np.minimum(after, n - 1)] == group[left])
        d_after = np.where(has_after, moment[np.minimum(after, n - 1)] - moment[left], _NEVER)
        after_id = number[np.minimum(after, n - 1)]
        waits = ~has_after & (group[left] == group[-1])
        settled = ~waits
        found.append(self._choose(number[left[settled]], before_id[settled], d_before[settled], after_id[settled], d_after[settled]))
        if waits.any():
            self.waiting.append((number[left[waits]], moment[left[waits]], before_id[waits], d_before[waits]))
        end = passed[-1]
        if end >= 0 and group[end] == group[-1]:
            self.last = int(group[end]), int(moment[end]), int(number[end])
        elif self.last is not None and self.last[0] != group[-1]:
            self.last = None
        return found

    def finish(self) -> list[_Found]:
        chunks, self.waiting = self.waiting, []
        return self._release(chunks)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str,
    left_time: str,
    left_id: str,
    right_time: str,
    right_id: str,
    tolerance_seconds: float,
) -> DataFrame:
    """(left_id, right_id, gap_seconds): each left row with the right row of its entity nearest in time.

    Ids are bigints. A pair is at most ``tolerance_seconds`` apart, both ends included; at equal
    distance the earlier right row counts, at equal time the smaller id. Left rows without partner,
    and rows of either side with a NULL entity, time or id, don't appear. A left row that comes
    twice is matched twice; other columns are ignored, whatever their names; an empty side gives an
    empty result.

    Both tables are hashed on entity and stretch of time, right rows near an edge going to both
    stretches, and sorted within partitions; each partition is one pass of the merge. A large
    entity is thus spread over its stretches and no group is held in memory.
    """
    tolerance = int(tolerance_seconds * 1_000_000)
    stretch = max(tolerance * STRETCH_TOLERANCES, 86_400_000_000)
    micros = lambda c: wall_micros(F.col(c))
    cell = lambda t: F.floor(t / F.lit(float(stretch)))
    lefts = left.select(F.col(by).alias("entity"), micros(left_time).alias("t"), F.col(left_id).cast("long").alias("id")).dropna()
    rights = right.select(F.col(by).alias("entity"), micros(right_time).alias("t"), F.col(right_id).cast("long").alias("id")).dropna()
    lefts = lefts.select("entity", cell(F.col("t")).alias("stretch"), "t", F.lit(1).cast("long").alias("side"), "id")
    near = F.array_distinct(F.array(*(cell(F.col("t") + d) for d in (-tolerance, 0, tolerance))))
    rights = rights.select("entity", F.explode(near).alias("stretch"), "t", F.lit(0).cast("long").alias("side"), "id")
    ordered = (
        lefts.unionByName(rights).repartition("entity", "stretch")
        .sortWithinPartitions("entity", "stretch", "t", "side", "id")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Merge(tolerance)
        for batch in batches:
            if len(batch):
                yield from (_pairs(*found) for found in state.push(batch))
        yield from (_pairs(*found) for found in state.finish())

    return ordered.mapInArrow(merge, "left_id long, right_id long, gap_seconds double")


def _pairs(left: np.ndarray, right: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(gap / 1e6, pa.float64())],
        ["left_id", "right_id", "gap_seconds"],
    )
