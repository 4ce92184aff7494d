"""Evaluation texts leaking into training text, by hash-joining windows of text templates.

A text is read as a row of terms. Numbers, names and units become typed placeholders in its
template and keep their wording as slots; all other words stand for themselves. Windows of
consecutive terms are hashed by template and hash-joined on that hash alone; the slots then decide.
Two readings are taken. In the reading by words every word is a term, without regard to case, and
equal slots make a verbatim leak. In the reading by terms a number with its points and commas, a run
of capitalised words and the unit after a number are one term each, and slots that map one to one
onto the item's make a question with new parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.runtime import fits, materialise

#: Terms of a window.
WINDOW = 12
#: Words of a window of the reading by terms that must stand for themselves.
LITERALS = 6

#: Names of units that are placeholders wherever they stand, as lower-case words.
UNITS = frozenset(
    "seconds minutes hours days weeks months years ppm ppb percent degrees mg ml ng kg km cm mm litres liters "
    "grams milligrams micrograms metres meters kilometres miles knots cells pixels".split()
)
#: Words that are no unit though they follow a number.
NO_UNITS = frozenset(
    "a an the and or but nor of in on at to for from by with without into over under than then as that which who when "
    "while where if is are was were be been has had have will would can may must not no".split()
)

#: Windows are looked up in a map of MAP_LOAD bits a window of the items before the join. Beyond
#: 2**MAP_MOST bits it grows no further: more windows pass it, and the join decides on them.
MAP_LOAD, MAP_MOST = 16, 28

#: Item windows are broadcast up to so many; beyond, documents' windows are spread by so many salts.
BROADCAST_WINDOWS, SALTS = 200_000, 16

_NUMBER, _NAME, _UNIT = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557), np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(r"[^\W_]+")
_SPACED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_TERM = re.compile(r"[^\W_]*\d[^\W_]*(?:[.,]\d+)*|[^\W\d_]+(?:['’/-][^\W\d_]+)*|°\w?|%|\n|[^\w\s]")
_ENDS = frozenset(".!?:;\n\"“(-–*|>)")
_MARK, _END, _COUNT, _CAPITAL, _KNOWN_CAPITAL, _ALWAYS_UNIT, _PERHAPS_UNIT, _PLAIN = range(8)
_SLICE = 1 << 20
_SEPARATOR = "\t"


def _words(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    if text.isascii():
        return text.lower().encode("ascii").translate(_SPACED).decode("ascii").split()
    return [word.lower() for word in _WORD.findall(text)]


class _Reading(NamedTuple):
    """Texts laid end to end as terms: how many each has, their wording, templates and slots (0 for a literal)."""

    lengths: np.ndarray
    terms: list[str]
    template: np.ndarray
    slots: np.ndarray


class _ByWords(dict):
    """Every word a term of its own; which words are names is the same for both sides and for any case.

    As a dict, word -> number of its codes, forgotten when there are too many.
    """

    salt, literals = np.uint64(0), 0

    def __init__(self, names: frozenset[str]):
        super().__init__()
        self.names, self.template, self.slots = names, [], []

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if any(map(str.isdigit, word)):
            code = int(_NUMBER)
        elif word in UNITS:
            code = int(_UNIT)
        else:
            code = int(_NAME) if word in self.names else value
        self.template.append(code)
        self.slots.append(0 if code == value else value)
        self[word] = at = len(self.slots) - 1
        return at

    def read(self, texts: list[str]) -> _Reading:
        if len(self) > 100_000:
            self.clear()
            self.template, self.slots = [], []
        parts = [_words(text) for text in texts]
        flat = [word for part in parts for word in part]
        index = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        return _Reading(np.array([len(p) for p in parts]), flat, np.array(self.template, np.uint64)[index], np.array(self.slots, np.uint64)[index])


class _ByTerms(dict):
    """Numbers, names and units of any number of words as one term each, decided by the text at hand.

    A run of capitalised words is a name. The first word of a sentence is part of it unless it is
    known: one that stands in lower case in some item. A word in lower case after a number is a unit.
    As a dict, token -> number of its kind and digest, forgotten when there are too many.
    """

    salt, literals = np.uint64(0xA0761D6478BD642F), LITERALS

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known = known
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.kinds, self.words, self.digests, self.names = [], [], [], {}

    def __missing__(self, token: str) -> int:
        word, first = token.lower(), token[0]
        symbol = first in "°%"
        if not first.isalnum() and not symbol:
            kind = _END if token in _ENDS else _MARK
        elif any(map(str.isdigit, token)) and not symbol:
            kind = _COUNT
        elif first.isupper():
            kind = _KNOWN_CAPITAL if word in self.known else _CAPITAL
        else:
            kind = _ALWAYS_UNIT if symbol or word in UNITS else _PLAIN if word in NO_UNITS else _PERHAPS_UNIT
        self.kinds.append(kind)
        self.words.append(word)
        self.digests.append(xxhash.xxh3_64_intdigest(word))
        self[token] = at = len(self.kinds) - 1
        return at

    def _name(self, words: list[str]) -> tuple[str, int]:
        """A name of several words and its digest."""
        wording = " ".join(words)
        found = self.names.get(wording)
        if found is None:
            found = self.names[wording] = wording, xxhash.xxh3_64_intdigest(wording)
        return found

    def read(self, texts: list[str]) -> _Reading:
        if len(self) + len(self.names) > 200_000:
            self._forget()
        parts = [_TERM.findall(text) for text in texts]
        sizes = np.array([len(p) for p in parts])
        index = np.fromiter((at for part in parts for at in map(self.__getitem__, part)), np.int64, int(sizes.sum()))
        if not len(index):
            return _Reading(np.zeros(len(texts), np.int64), [], np.empty(0, np.uint64), np.empty(0, np.uint64))
        kind = np.array(self.kinds, np.int8)[index]
        owner = np.repeat(np.arange(len(texts)), sizes)
        opens = np.ones(len(index), bool)
        opens[1:] = owner[1:] != owner[:-1]
        spoken = np.flatnonzero((kind != _MARK) & (kind != _END))
        # an end of a sentence, or the begin of the text, since the term before
        ends = np.cumsum((kind == _END) | opens)
        initial = np.ones(len(spoken), bool)
        initial[1:] = ends[spoken[1:]] > ends[spoken[:-1]]
        kinds, tokens = kind[spoken], index[spoken]
        next_to = np.zeros(len(spoken), bool)
        next_to[1:] = (spoken[1:] == spoken[:-1] + 1) & ~opens[spoken[1:]]
        counted = np.zeros(len(spoken), bool)
        counted[1:] = next_to[1:] & (kinds[:-1] == _COUNT)
        name = (kinds == _CAPITAL) | ((kinds == _KNOWN_CAPITAL) & ~initial)
        unit = (kinds == _ALWAYS_UNIT) | ((kinds == _PERHAPS_UNIT) & counted)
        # capitalised words side by side are one term
        joins = np.zeros(len(spoken), bool)
        joins[1:] = next_to[1:] & name[1:] & name[:-1]
        begins = np.flatnonzero(~joins)
        stops = np.append(begins[1:], len(spoken))
        first = tokens[begins]
        words = self.words
        terms = [words[i] for i in first.tolist()]
        digests = np.array(self.digests, np.uint64)[first]
        for at in np.flatnonzero(stops - begins > 1).tolist():
            terms[at], digests[at] = self._name([words[i] for i in tokens[begins[at] : stops[at]].tolist()])
        template = digests.copy()
        for which, code in ((kinds == _COUNT, _NUMBER), (name, _NAME), (unit, _UNIT)):
            template[which[begins]] = code
        held = (kinds == _COUNT) | name | unit
        slots = np.where(held[begins], digests, np.uint64(0))
        return _Reading(np.bincount(owner[spoken[begins]], minlength=len(texts)), terms, template, slots)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


class _Hasher:
    """Hashes of all windows of an array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def windows(self, codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        prefix = np.zeros(n, np.uint64)
        np.cumsum(codes * self.up[: n - 1], out=prefix[1:])
        return (prefix[size:] - prefix[:-size]) * self.down[: n - size]


_Wanted = Callable[[np.ndarray], np.ndarray]


def _scan(ids: list[int], texts: list[str], reader: _ByWords | _ByTerms, hasher: _Hasher, size: int, wanted: _Wanted) -> Iterator[tuple]:
    """(id, by_terms, template hash, slot hash, place, terms) of the windows that are wanted."""
    read = reader.read(texts)
    if len(read.terms) < size:
        return
    template = hasher.windows(read.template, size) ^ reader.salt
    ends = np.cumsum(read.lengths)
    inside = np.ones(len(read.terms), bool)
    for back in range(1, size):
        cut = ends - back
        inside[cut[cut >= 0]] = False
    inside = inside[: len(template)]
    if reader.literals:
        literal = np.concatenate(([0], np.cumsum(read.slots == 0)))
        inside &= literal[size:] - literal[:-size] >= reader.literals
    hits = np.flatnonzero(inside & wanted(template))
    if not len(hits):
        return
    slots = hasher.windows(read.slots, size)
    owner = np.searchsorted(ends, hits, side="right")
    firsts = ends - read.lengths
    by_terms = reader.literals > 0
    for at, which in zip(hits.tolist(), owner.tolist()):
        yield (
            ids[which], by_terms, int(template[at].astype(np.int64)), int(slots[at].astype(np.int64)), at - int(firsts[which]),
            _SEPARATOR.join(read.terms[at : at + size]),
        )


_SCHEMA = "id long, by_terms boolean, template long, slots long, place long, terms string"
_ARROW = pa.schema([
    ("id", pa.int64()), ("by_terms", pa.bool_()), ("template", pa.int64()), ("slots", pa.int64()), ("place", pa.int64()), ("terms", pa.string())
])


def template_windows(texts: DataFrame, names: frozenset[str], known: frozenset[str] | None, size: int, wanted: _Wanted) -> DataFrame:
    """The wanted windows of (id, text), as in _SCHEMA; by terms too unless ``known`` is None."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, readers = _Hasher(), [_ByWords(names)] + ([] if known is None else [_ByTerms(known)])
        for batch in batches:
            ids, bodies, held = [], [], 0
            found: list[tuple] = []
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number is None or not body.is_valid:
                    continue
                ids.append(number)
                bodies.append(body.as_py())
                held += len(bodies[-1])
                if held > _SLICE:
                    for reader in readers:
                        found.extend(_scan(ids, bodies, reader, hasher, size, wanted))
                    ids, bodies, held = [], [], 0
            for reader in readers:
                found.extend(_scan(ids, bodies, reader, hasher, size, wanted))
            columns = list(zip(*found)) or [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return texts.mapInArrow(scan, _SCHEMA)


def _everything(template: np.ndarray) -> np.ndarray:
    return np.ones(len(template), bool)


def name_words(texts: DataFrame, text: str = "text") -> frozenset[str]:
    """Words that stand capitalised within sentences, or first in one and nowhere in lower case.

    They are the names of the reading by words. Which words are names never decides whether a
    verbatim leak is found, as both sides use the same ones without regard to case.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?<=[a-z0-9,;] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), F.lit(1))
    inner = texts.select(F.explode(F.split(F.array_join(runs, " "), " ")).alias("w"), F.lit(1).alias("inner"))
    every = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("w"), F.lit(0).alias("inner"))
    words = inner.unionByName(every).where("w <> ''").groupBy(F.lower("w").alias("w")).agg(
        F.sum("inner").alias("inner"), F.count_if(F.expr(r"inner = 0 AND w RLIKE '^\\p{Lu}\\p{Ll}+$'")).alias("capital"),
        F.count_if(F.expr(r"inner = 0 AND w RLIKE '^\\p{Ll}'")).alias("lower"),
    )
    found = words.where((F.col("inner") > 0) | ((F.col("capital") > 0) & (F.col("lower") == 0)))
    return frozenset(found.select("w").toArrow().column(0).to_pylist())


def lower_words(texts: DataFrame, text: str = "text") -> frozenset[str]:
    """The words that stand in lower case somewhere in the texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {token for body in batch.column(0).to_pylist() if body is not None for token in _TERM.findall(body) if token[0].islower()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    return frozenset(texts.select(text).mapInArrow(split, "w string").distinct().toArrow().column(0).to_pylist())


def _place_of(template: np.ndarray, bits: int) -> np.ndarray:
    return ((template ^ (template >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def window_map(windows: DataFrame) -> _Wanted:
    """Whether a template hash may be among those of ``windows``: a bit map of a size by their number.

    Bits are set and joined where the windows are; the driver gets one row per word of the map that is
    not empty, at most 2**MAP_MOST / 64.
    """
    bits = min(max(int(MAP_LOAD * windows.count() + 1).bit_length(), 16), MAP_MOST)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_place_of(batch.column(0).to_numpy().view(np.uint64), bits))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    taken = windows.select("template").mapInArrow(to_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(1 << (bits - 6), np.uint64)
    masks[taken.column(0).to_numpy()] = taken.column(1).to_numpy().view(np.uint64)

    def wanted(template: np.ndarray) -> np.ndarray:
        place = _place_of(template, bits)
        return (masks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    return wanted


def _consistent(mine: Column, other: Column) -> Column:
    """Whether terms at equal places map one to one onto each other."""
    pairs = F.arrays_zip(F.split(mine, _SEPARATOR).alias("a"), F.split(other, _SEPARATOR).alias("b"))
    distinct = F.size(F.array_distinct(pairs))
    return (distinct == F.size(F.array_distinct(pairs["a"]))) & (distinct == F.size(F.array_distinct(pairs["b"])))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    size: int = WINDOW,
    verbatim: bool = True,
) -> DataFrame:
    """(doc_id, item_id, verbatim_windows, reworded_windows): documents that hold passages of items.

    ``verbatim_windows`` counts the places of the document where ``size`` consecutive words are the
    item's, as maximal runs of letters and digits without regard to case; every such pair is found.
    With ``verbatim`` false, ``reworded_windows`` counts those where ``size`` terms have the item's
    template, at least LITERALS of them words, and slots that are not all equal but map one to one:
    passages with other numbers, names or units, of any number of words. A name must be capitalised
    where it stands and must not begin a sentence with a word that items hold in lower case.

    Rows with a NULL id or text and texts of fewer terms hold nothing; repeated rows and windows
    count once per place; other columns are ignored; an empty side gives an empty result.

    The corpus is read once. Its windows pass a bit map made from the items' windows, and what passes
    is hash-joined on the template and kept or not by its slots; a chance hit of the map joins nothing.
    The join is by broadcast if a count bounds the items' windows. Else both sides shuffle, documents'
    windows of a stock phrase being spread by salts. What the driver holds besides the map are the
    words of the items.
    """
    names = name_words(items, text)
    known = None if verbatim else lower_words(items, text)
    rows = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    of_items = materialise(template_windows(rows(items, item_id), names, known, size, _everything), "item-windows")
    of_documents = template_windows(rows(documents, doc_id), names, known, size, window_map(of_items)).withColumnRenamed("id", "doc_id")
    item_side = of_items.select(F.col("id").alias("item_id"), "template", F.col("slots").alias("item_slots"), F.col("terms").alias("item_terms")).distinct()
    if fits(item_side, BROADCAST_WINDOWS):
        met = of_documents.join(F.broadcast(item_side), "template")
    else:
        salted = of_documents.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
        met = salted.join(item_side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["template", "salt"])
    equal = (F.col("slots") == F.col("item_slots")) & (F.col("terms") == F.col("item_terms"))
    reworded = F.col("by_terms") & (F.col("slots") != F.col("item_slots")) & _consistent(F.col("terms"), F.col("item_terms"))
    same = ~F.col("by_terms") & equal
    judged = met.where(same if verbatim else same | reworded)
    return judged.groupBy("doc_id", "item_id").agg(
        F.count_distinct(F.when(same, F.col("place"))).alias("verbatim_windows"),
        F.count_distinct(F.when(F.col("by_terms"), F.col("place"))).alias("reworded_windows"),
    )
