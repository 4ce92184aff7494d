"""Filling containers of fixed capacity with texts: shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.runtime import materialise

#: Fixed value: the pre-tokenising pattern that belongs to the public 50k byte-level vocabulary.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces of a length are ranked in independent parts of about so many rows, so that no length is a hot key.
RANK_ROWS = 500_000


def default_vocabulary() -> str:
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def count_tokens(
    texts: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = BYTE_BPE_PATTERN
) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; NULL and empty texts have 0 tokens.

    ``vocabulary`` is the path of a rank file that every executor can read.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            lengths = [len(encode(x.as_py())) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    rows = texts.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


@dataclass
class Pattern:
    """So many containers with the same lengths in the same order."""

    count: int
    lengths: list[int] = field(default_factory=list)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Packing patterns that place every item of a histogram length -> number.

    Lengths are placed longest first; each goes into the container with the shortest content,
    that is the most space, and only if none has room a container is opened. Containers of equal
    content are one pattern with a count, so the work depends on the number of lengths alone.
    """
    by_space: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left, space = histogram[length], capacity
        while left:
            while space >= length and not by_space[space]:
                space -= 1
            if space < length:
                # as many of this length to a new container as would fit, and one for the rest
                each = capacity // length
                full, rest = divmod(left, each)
                for count, items in ((full, each), (1, rest)):
                    if count and items:
                        by_space[capacity - items * length].append(Pattern(count, [length] * items))
                break
            pattern = by_space[space][-1]
            if pattern.count <= left:
                by_space[space].pop()
                moved = pattern
            else:
                pattern.count -= left
                moved = Pattern(left, list(pattern.lengths))
            moved.lengths.append(length)
            left -= moved.count
            by_space[space - length].append(moved)
    return [pattern for patterns in by_space for pattern in patterns]


@dataclass(frozen=True)
class Slots:
    """Where the items of each length go: slot i takes ranks from ``start[i]`` to the next start."""

    first_rank: dict[int, int]
    start: np.ndarray
    container: np.ndarray
    offset: np.ndarray


def lay_out(patterns: list[Pattern]) -> Slots:
    rows: list[tuple[int, int, int, int]] = []
    base = 0
    for pattern in patterns:
        at = 0
        for length in pattern.lengths:
            rows.append((length, pattern.count, base, at))
            at += length
        base += pattern.count
    rows.sort()
    first_rank: dict[int, int] = {}
    start, total = [], 0
    for length, count, _, _ in rows:
        first_rank.setdefault(length, total)
        start.append(total)
        total += count
    take = lambda i: np.array([row[i] for row in rows], np.int64)
    return Slots(first_rank, np.array(start, np.int64), take(2), take(3))


def pack_texts(
    texts: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    vocabulary: str | None = None,
    pattern: str = BYTE_BPE_PATTERN,
) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id, container_offset), a row per piece of a text.

    A text that fits a container is one piece, never divided; a longer one is cut into pieces
    that fill a container each and one with what is left. NULL and empty texts need no space:
    one row with 0 tokens and a NULL container. Repeated ids are packed as often as they come;
    further columns are ignored; an empty table gives an empty result.

    Texts are read once, for their lengths. What reaches the driver is the histogram of at most
    ``capacity`` lengths and, for lengths of more than RANK_ROWS pieces, a count per RANK_ROWS of them.
    What goes back is those counts and the table of packing slots, whose size depends on the capacity
    alone. Pieces find their container by rank among those of their length.
    """
    lengths = materialise(count_tokens(texts, doc_id=doc_id, text=text, vocabulary=vocabulary, pattern=pattern), "lengths")
    starts = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long")))
    pieces = lengths.select(
        "doc_id", F.posexplode_outer(starts).alias("piece", "token_start"), F.col("n_tokens").alias("whole")
    ).select(
        "doc_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("token_start", F.lit(0)).alias("token_start"),
        F.least(F.col("whole") - F.coalesce("token_start", F.lit(0)), F.lit(capacity)).alias("n_tokens"),
    )
    sized = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    by_length = dict(zip(sized.column(0).to_pylist(), sized.column(1).to_pylist()))
    parts = np.ones(capacity + 1, np.int64)
    for length, n in by_length.items():
        parts[length] = -(-n // RANK_ROWS)
    split = [(int(length), int(parts[length])) for length in np.flatnonzero(parts > 1)]
    spread = texts.sparkSession.createDataFrame(split, "n_tokens long, parts int")
    pieces = pieces.join(F.broadcast(spread), "n_tokens", "left").select(
        "doc_id", "piece", "token_start", "n_tokens", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), "parts"), F.lit(0)).cast("int").alias("part"), "parts",
    )
    # rank of the first piece of each part among those of its length, parts laid end to end
    first_part = np.cumsum(parts) - parts
    before = np.zeros(int(parts.sum()), np.int64)
    counts = pieces.where("parts IS NOT NULL").groupBy("n_tokens", "part").agg(F.count("*").alias("n")).toArrow()
    for length, part, n in zip(*(counts.column(i).to_pylist() for i in range(3))):
        before[first_part[length] + part] = n
    for length, _ in split:
        own = slice(first_part[length], first_part[length] + parts[length])
        before[own] = np.cumsum(before[own]) - before[own]
    slots = lay_out(pack_histogram(by_length, capacity))
    for length, rank in slots.first_rank.items():
        before[first_part[length] : first_part[length] + parts[length]] += rank

    in_part = Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")
    ranked = pieces.drop("parts").withColumn("rank", F.row_number().over(in_part) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, rank = (batch.column(i).to_numpy() for i in (3, 4, 5))
            number = before[first_part[length] + part] + rank
            slot = np.maximum(np.searchsorted(slots.start, number, side="right") - 1, 0)
            nothing = length == 0
            if len(slots.start):
                container, offset = slots.container[slot] + number - slots.start[slot], slots.offset[slot]
            else:
                container, offset = number, number
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(container, pa.int64(), mask=nothing), pa.array(offset, pa.int64(), mask=nothing)],
                ["doc_id", "piece", "token_start", "n_tokens", "container_id", "container_offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, token_start long, n_tokens long, container_id long, container_offset long"
    )
