"""Long exact spans shared between texts, by content-defined chunks of a gear rolling hash.

A chunk begins where the rolling hash of the last GEAR characters is the least within a run of
RUN positions, and ends at the least hash within TAIL positions after MIN_CHUNK characters. Both
depend on nothing but the text of the chunk's reach, so chunks survive insertions elsewhere, and
the parameters are such that every stretch of ``span`` characters contains a whole chunk: a shared
stretch always shares a chunk. Chunks are deduplicated by digest; the windows of ``span`` characters
whose chunk recurs are then compared exactly, by their own digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.runtime import bounded_broadcast, materialise, possibly_in

GEAR = 32
MIN_CHUNK = 128
TAIL = 32

#: The texts that share chunks are broadcast with those chunks if there are at most so many in all.
#: More are met by a shuffle of the texts that a bit map of their ids lets through.
LISTED = 2_000_000

_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_SLICE = 1 << 19


def _mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    x = numbers.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = 1 << 16
#: One random number per character; characters beyond the table are mixed when met.
_GEAR_TABLE = (_mixed(np.arange(_TABLE), 0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash that ends at each character: a sum of shifted gears, built by doubling."""
    h = _GEAR_TABLE[codes & (_TABLE - 1)]
    high = codes >= _TABLE
    if high.any():
        h[high] = _mixed(codes[high], 1).astype(np.uint32)
    width = 1
    while width < GEAR:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h | np.uint32(1)


def _slide(values: np.ndarray, run: int, best) -> np.ndarray:
    """best over values[i : i + run] for every i; shorter at the end by run - 1."""
    width, out = 1, values
    while width * 2 <= run:
        out = best(out[:-width], out[width:])
        width *= 2
    rest = run - width
    return best(out[:-rest], out[rest:]) if rest else out


class _Digests:
    """Digests of any stretch of the characters in hand: prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def load(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        if len(self.up) < n:
            self.up, self.down = (np.full(n, b, np.uint64) for b in (self.base, self.inverse))
            self.up[:1] = self.down[:1] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_mixed(codes, self.base) * self.up[: n - 1], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.down[begin]


class _Texts:
    """Texts of at least ``span`` characters laid end to end, with their chunks."""

    def __init__(self, texts: list[str], span: int, digests: _Digests):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(np.array([len(x) for x in texts]))
        self.begins = np.append(0, self.ends[:-1])
        digests.load(self.codes)
        reach = MIN_CHUNK + TAIL
        self.run = run = span - reach + 1
        h = _gear(self.codes)
        # runs of positions that lie within one text, with room for the whole reach of a chunk
        steps = np.zeros(len(h) + 1, np.int32)
        np.add.at(steps, self.begins + GEAR - 1, 1)
        np.add.at(steps, self.ends - reach + GEAR - run + 1, -1)
        lowest = _slide(h, run, np.minimum)
        self.within = np.cumsum(steps[: len(lowest)]) > 0
        lowest = np.where(self.within, lowest, np.uint32(0))
        padded = np.concatenate([np.zeros(run - 1, np.uint32), lowest, np.zeros(run - 1, np.uint32)])
        self.marks = marks = np.flatnonzero(_slide(padded, run, np.maximum) == h)
        self.rank = h[marks]
        self.chunk_begin = marks - (GEAR - 1)
        tail = (self.chunk_begin + MIN_CHUNK - 1)[:, None] + np.arange(TAIL)
        self.chunk_end = tail[:, 0] + np.argmin(h[tail], axis=1) + 1
        self.digest = digests.of(self.chunk_begin, self.chunk_end)
        self.owner = np.searchsorted(self.ends, self.chunk_begin, side="right")

    def starts_with(self, chosen: np.ndarray) -> np.ndarray:
        """Where windows of ``span`` characters begin whose own chunk is chosen.

        A window holds exactly one run of positions together with the chunks' reach; the chunk of
        its least hash (of equal ones, any that is chosen) is there wherever the window recurs.
        """
        ranks = np.full(len(self.codes), np.iinfo(np.int64).max)
        ranks[self.marks] = (self.rank.astype(np.int64) << 1) | ~chosen
        lowest = _slide(ranks, self.run, np.minimum)
        return np.flatnonzero(self.within & (lowest & 1 == 0)) - (GEAR - 1)


def _longest_span(span: int) -> None:
    if span < MIN_CHUNK + TAIL + 64:
        raise ValueError(f"spans of fewer than {MIN_CHUNK + TAIL + 64} characters need smaller chunks")


def _slices(batch: pa.RecordBatch, columns: int, span: int) -> Iterator[list[list]]:
    """Rows of a batch whose id and text are given and whose text is long enough, by total length."""
    rows: list[list] = [[] for _ in range(columns)]
    held = 0
    others = [batch.column(i).to_pylist() if i != 1 else None for i in range(columns)]
    for n, body in enumerate(batch.column(1)):
        if others[0][n] is None or not body.is_valid:
            continue
        text = body.as_py()
        if len(text) < span:
            continue
        for i in range(columns):
            rows[i].append(text if i == 1 else others[i][n])
        held += len(text)
        if held > _SLICE:
            yield rows
            rows, held = [[] for _ in range(columns)], 0
    if rows[0]:
        yield rows


def chunk_digests(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id, whole, digests): the digest of each whole text and the distinct ones of its chunks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first = _Digests(_BASES[0])
        for batch in batches:
            for ids, bodies in _slices(batch, 2, span):
                held = _Texts(bodies, span, first)
                order = np.lexsort((held.digest, held.owner))
                owner, digest = held.owner[order], held.digest[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
                counts = np.bincount(owner[fresh], minlength=len(ids))
                offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                whole = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in bodies]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(digest[fresh].view(np.int64)))],
                    ["doc_id", "whole", "digests"],
                )

    return texts.mapInArrow(scan, "doc_id long, whole binary, digests array<long>")


def _windows(texts: DataFrame, span: int, places: bool) -> DataFrame:
    """(h1, h2, doc_id, place) of the windows of (doc_id, text, shared) whose chunk is shared."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (_Digests(b) for b in _BASES)
        odd = np.uint64(_BASES[1])
        for batch in batches:
            for ids, bodies, shared in _slices(batch, 3, span):
                held = _Texts(bodies, span, first)
                second.load(held.codes)
                which = np.repeat(np.arange(len(ids)), [len(x) for x in shared]).astype(np.uint64)
                known = np.concatenate([np.array(x, np.int64) for x in shared]).view(np.uint64) ^ (which * odd)
                recurs = np.isin(held.digest ^ (held.owner.astype(np.uint64) * odd), known)
                starts = held.starts_with(recurs)
                owner = np.searchsorted(held.ends, starts, side="right")
                h1, h2 = first.of(starts, starts + span), (second.of(starts, starts + span) >> np.uint64(32)).astype(np.uint32)
                if not places:
                    order = np.lexsort((h1, owner))
                    a, b = owner[order], h1[order]
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    keep = np.sort(order[fresh])
                    starts, owner, h1, h2 = starts[keep], owner[keep], h1[keep], h2[keep]
                out = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(np.array(ids, np.int64)[owner])]
                if places:
                    out.append(pa.array((starts - held.begins[owner]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(out, ["h1", "h2", "doc_id", "place"][: len(out)])

    return texts.mapInArrow(scan, "h1 long, h2 int, doc_id long" + ", place int" * places)


class SharedSpans:
    """The parts of the search that its reports have in common."""

    def __init__(self, documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 300):
        _longest_span(span)
        self.span = span
        self.texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        chunks = materialise(chunk_digests(self.texts, span), "chunks")
        #: (class_id, doc_id) of every text that has exact copies; the class is its smallest id.
        classes = chunks.groupBy("whole").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
        self.copies = materialise(
            chunks.select("whole", "doc_id").join(classes.select("whole", "class_id"), "whole").select("class_id", "doc_id"), "copies"
        )
        again = self.copies.where("doc_id <> class_id").select("doc_id")
        own = chunks.select("doc_id", F.explode("digests").alias("digest")).join(bounded_broadcast(again), "doc_id", "left_anti")
        recurring = materialise(own.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "recurring")
        self.candidates = materialise(
            own.join(bounded_broadcast(recurring), "digest").groupBy("doc_id").agg(F.collect_list("digest").alias("shared")), "candidates"
        )

    def windows(self, places: bool) -> DataFrame:
        """The windows whose chunk recurs, written, as they are used more than once.

        Texts aren't shuffled where the candidates are few enough to be broadcast. Where they are more,
        a bit map of their ids keeps the other texts out of the shuffle.
        """
        sums = self.candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()
        if sum(sums) <= LISTED:
            joined = self.texts.join(F.broadcast(self.candidates), "doc_id")
        else:
            joined = possibly_in(self.texts, "doc_id", self.candidates.select("doc_id"), sums[0]).join(self.candidates, "doc_id")
        return materialise(_windows(joined.select("doc_id", "text", "shared"), self.span, places), "windows")

    def holders(self) -> DataFrame:
        """(h1, h2, doc_id): sets of texts that share a stretch, each under one window that all of it hold.

        For each window the texts that hold it are counted and fingerprinted by commutative aggregates,
        summed up before the shuffle, and one window stands for all with the same texts. So a long shared
        stretch counts once and no group of texts is ever collected.
        """
        windows = self.windows(False)
        sets = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).where("n > 1")
        chosen = materialise(sets.groupBy("n", "members").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.h1", "h.h2"), "chosen")
        return materialise(windows.join(bounded_broadcast(chosen), ["h1", "h2"]).select("h1", "h2", "doc_id"), "holders")


def shared_groups(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> DataFrame:
    """(group_id, doc_id, members): groups of texts that all hold one stretch of ``span`` characters, a row per member.

    Two texts share such a stretch exactly if they are in one group together; a text may be in several.
    The rows are as many as memberships, so a stretch in a million texts is a million rows and not their
    pairs. Exact copies are members like any other. As for the rest, see :func:`shared_pairs`.
    """
    found = SharedSpans(documents, doc_id=doc_id, text=text, span=span)
    through = found.holders().join(found.copies.withColumnRenamed("doc_id", "copy"), F.col("doc_id") == F.col("class_id"), "left")
    shared = through.select(F.xxhash64("h1", "h2").alias("group_id"), F.coalesce("copy", "doc_id").alias("doc_id"))
    rows = shared.unionByName(found.copies.select(F.xxhash64("class_id").alias("group_id"), "doc_id"))
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("members"))
    return rows.join(bounded_broadcast(sizes), "group_id").select("group_id", "doc_id", "members")


def shared_pairs(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller id first: texts with ``span`` equal consecutive characters.

    Characters are code points, exactly as written, compared by digests of 96 bits. Rows with a NULL id
    or text and texts shorter than ``span`` have no partner; ids are taken as unique; other columns are
    ignored; an empty table gives an empty result.

    Pairs are those within the sets of :meth:`SharedSpans.holders`. Exact copies take part once, through
    their smallest id, and come back at the end; the joins' size is that of the result.
    """
    found = SharedSpans(documents, doc_id=doc_id, text=text, span=span)
    holders = found.holders()
    a, b = (holders.select("h1", "h2", F.col("doc_id").alias(x)) for x in ("a", "b"))
    pairs = a.join(b, ["h1", "h2"]).where("a < b").select("a", "b").distinct()
    side = lambda x: found.copies.select(F.col("class_id").alias(x), F.col("doc_id").alias(f"{x}_copy"))
    spread = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("a_copy", "a").alias("x"), F.coalesce("b_copy", "b").alias("y")
    )
    within = (
        found.copies.select("class_id", F.col("doc_id").alias("x"))
        .join(found.copies.select("class_id", F.col("doc_id").alias("y")), "class_id").where("x < y").select("x", "y")
    )
    return spread.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_lengths(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, class_id): how much of each text other texts hold.

    ``shared_chars`` counts the characters within stretches of at least ``span`` characters that
    occur verbatim in another text; ``class_id`` is the smallest id among exact copies of at least
    that length, else the text's own. Every row with an id comes out; a NULL text has 0 characters.
    """
    found = SharedSpans(documents, doc_id=doc_id, text=text, span=span)
    windows = found.windows(True)
    held = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    covered = windows.join(held.select("h1", "h2"), ["h1", "h2"]).select("doc_id", "place")
    following = F.lead("place").over(Window.partitionBy("doc_id").orderBy("place"))
    stretches = covered.select("doc_id", F.least(F.coalesce(following - F.col("place"), F.lit(span)), F.lit(span)).alias("new"))
    sums = stretches.groupBy("doc_id").agg(F.sum("new").alias("partly"))
    sizes = found.texts.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    joined = sizes.join(sums, "doc_id", "left").join(found.copies, "doc_id", "left")
    shared = F.when(F.col("class_id").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("partly", F.lit(0))).cast("long")
    return joined.select(
        "doc_id", "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )
