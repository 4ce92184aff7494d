"""The llm operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import functools
import os
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegrid.llm import leakage, packing, spans
from tidegrid.llm.leakage import leaks
from tidegrid.llm.nearest_time import nearest_in_time
from tidegrid.llm.packing import count_tokens, default_vocabulary, pack_histogram, pack_texts
from tidegrid.llm.spans import shared_groups, shared_lengths, shared_pairs

DOCS = "doc_id long, text string, digest string, whole string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts, 1)], DOCS)


# -- nearest in time -----------------------------------------------------------------------------


@pytest.mark.parametrize("batch", [3, 10_000])
def test_nearest(spark, batch):
    rng = random.Random(5)
    base = datetime(2020, 1, 1)
    moment = lambda: base + timedelta(minutes=30 * rng.randrange(0, 48 * 90)) if rng.random() > 0.05 else None
    left = [(i, rng.choice(["a", "hot", "hot", None]), moment(), "clash") for i in range(400)]
    right = [(1000 + i, rng.choice(["a", "hot", "hot", "b", None]), moment(), "clash") for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        a = spark.createDataFrame(left, "id long, site string, t timestamp, side string")
        b = spark.createDataFrame(right, "id long, site string, t timestamp, entity string")
        got = sorted((r[0], r[1]) for r in nearest_in_time(a, b, by="site", left_time="t", left_id="id", right_time="t", right_id="id", tolerance_seconds=3600 * 6).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    expected = []
    for i, site, t, _ in left:
        near = [(abs(u - t), u, j) for j, s, u, _ in right if site is not None and s == site and t is not None and u is not None and abs(u - t) <= timedelta(hours=6)]
        if near:
            expected.append((i, min(near)[2]))
    assert got == sorted(expected)


def test_nearest_empty_and_far(spark):
    a = spark.createDataFrame([(1, "a", datetime(1950, 1, 1))], "id long, site string, t timestamp")
    options = dict(by="site", left_time="t", left_id="id", right_time="t", right_id="id", tolerance_seconds=60)
    assert nearest_in_time(a, a.limit(0), **options).count() == 0
    assert nearest_in_time(a.limit(0), a, **options).count() == 0
    assert [tuple(r) for r in nearest_in_time(a, a, **options).collect()] == [(1, 1, 0.0)]


# -- packing -------------------------------------------------------------------------------------


def test_histogram_packs_everything():
    rng = random.Random(2)
    for capacity in (1, 7, 100, 2048):
        histogram = {n: rng.randrange(1, 200) for n in rng.sample(range(1, capacity + 1), min(capacity, 60))}
        patterns = pack_histogram(histogram, capacity)
        placed = defaultdict(int)
        for p in patterns:
            assert 0 < sum(p.lengths) <= capacity and p.count > 0
            for n in p.lengths:
                placed[n] += p.count
        assert placed == histogram
        total = sum(n * c for n, c in histogram.items())
        assert sum(p.count for p in patterns) <= 2 * -(-total // capacity)
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


@pytest.mark.parametrize("rank_rows", [500_000, 7])
@pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary file")
def test_packing_round_trip(spark, rank_rows, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    rng = random.Random(4)
    texts = [None, "", "ok", " "] + ["ok"] * 50 + [" ".join(rng.choice(["razor", "clam", "tide", "1.5"]) for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["word " * 1000]
    df = documents(spark, texts)
    lengths = {r[0]: r[1] for r in count_tokens(df).collect()}
    capacity = 64
    rows = pack_texts(df, capacity=capacity).collect()
    by_doc, by_container = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        if r["container_id"] is not None:
            by_container[r["container_id"]].append(r)
    assert by_doc.keys() == lengths.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in pieces) == lengths[doc]
        assert [r["token_start"] for r in pieces] == [capacity * i for i in range(len(pieces))]
        assert len(pieces) == max(1, -(-lengths[doc] // capacity))
        assert all((r["container_id"] is None) == (r["n_tokens"] == 0) for r in pieces)
    for held in by_container.values():
        held.sort(key=lambda r: r["container_offset"])
        end = 0
        for r in held:
            assert r["container_offset"] == end
            end += r["n_tokens"]
        assert end <= capacity
    assert sorted(by_container) == list(range(len(by_container)))
    assert len(by_container) <= 1.1 * sum(lengths.values()) / capacity + 1
    assert pack_texts(df.limit(0), capacity=capacity).count() == 0
    assert pack_texts(documents(spark, [None, ""]), capacity=capacity).count() == 2


# -- leaks ---------------------------------------------------------------------------------------


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("sal", "mar", "tor", "vin", "kel") for b in ("do", "ra", "ne", "si", "x7", "é")] + ["Harrow", "12", "hours"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [sentence(30) for _ in range(20)] + [None, "", "short text"]
    items.append(items[0])
    texts = [None, "", "x"]
    for i in range(60):
        part = items[rng.randrange(20)].split()
        at, n = rng.randrange(15), rng.choice([5, 11, 12, 13, 15])
        joint = rng.choice([" ", ", ", "\n", "_", " -- "])
        texts.append(sentence(40) + ". " + joint.join(w.upper() if rng.random() < 0.3 else w for w in part[at : at + n]) + "; " + sentence(30 if i else 60_000))
    windows = defaultdict(set)
    for i, item in enumerate(items, 1):
        w = words_of(item)
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i)
    expected = set()
    for doc, text in enumerate(texts, 1):
        w = words_of(text)
        for k in range(len(w) - 11):
            expected |= {(doc, i) for i in windows.get(tuple(w[k : k + 12]), ())}
    item_frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(items, 1)], "item_id long, text string, template string")
    assert len(expected) > 10
    assert {(r["doc_id"], r["item_id"]) for r in leaks(documents(spark, texts), item_frame).collect()} == expected
    assert leaks(documents(spark, texts), item_frame.limit(0)).count() == 0
    assert leaks(documents(spark, texts).limit(0), item_frame).count() == 0


def test_new_parameters(spark):
    item = "Decide whether the beach may open when the composite taken near Scour Beach was thawed for 104 hours before it was read by form 12 or form 104"
    swap = lambda *changes: functools.reduce(lambda t, c: t.replace(*c), changes, item)
    docs = [
        swap(("104", "77"), ("Scour Beach", "Harrow Narrows")), item, swap(("thawed", "frozen"), ("composite", "sample"), ("open", "close"), ("before", "after")),
        swap(("104", "1.5")), swap(("104", "1,200"), ("Scour Beach", "Ruckle")), swap(("Scour Beach", "Far Ruckle Été")), swap(("hours", "fortnights")),
        swap(("Scour Beach", "Sample Closed")), swap(("Scour Beach", "muddy creeks")).replace("Decide whether the beach may open when ", ""),
        item.lower(), item.title(), swap(("form 104", "form 12")), "Ruckle Narrows was closed when the composite that had been thawed for nine hours before it was read",
    ]
    starts = "Scour Harbour was closed when the composite that had been thawed for nine hours before it was read"
    items = spark.createDataFrame([(1, item), (2, starts)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(documents(spark, docs), items, verbatim=False).collect()}
    n = len(words_of(item)) - 11
    assert {d for d, i in got if i == 1} == {1, 2, 4, 5, 6, 7, 8, 10, 11, 12} | {d for d in (9,) if (9, 1) in got and got[9, 1]["verbatim_windows"]}
    assert all(got[d, 1]["reworded_windows"] >= 8 for d in (1, 4, 5, 6, 7, 8))
    assert [got[d, 1]["verbatim_windows"] for d in (2, 10, 11)] == [n] * 3 and got[1, 1]["verbatim_windows"] == 0
    # a number that stands for two different ones is no consistent change where the window holds both
    assert 0 < got[12, 1]["verbatim_windows"] < n and got[12, 1]["reworded_windows"] < got[4, 1]["reworded_windows"]
    assert got[13, 2]["reworded_windows"] > 0
    assert {(r[0], r[1]) for r in leaks(documents(spark, docs), items).select("doc_id", "item_id").collect()} >= {(2, 1), (10, 1), (11, 1)}


def reparameterised(rng, text, items_words):
    """The text with every number, name and unit after a number replaced, one for one, by others of any length."""
    number = lambda: rng.choice([str(rng.randrange(2, 99_999)), f"{rng.uniform(0, 99):.2f}", f"{rng.randrange(1000, 9_999_999):,}"])
    syllables = ["ra", "ven", "tor", "mel", "gos", "wick", "dun", "fell"]
    part = lambda: rng.choice(items_words).capitalize() if rng.random() < 0.2 else "".join(rng.choices(syllables, k=2)).capitalize()
    name = lambda: " ".join(part() for _ in range(rng.choice([1, 2, 2, 3])))
    taken = {}

    def other(found, make):
        while found not in taken or list(taken.values()).count(taken[found]) > 1:
            taken[found] = make()
        return taken[found]

    units = r"(?<=\d )(?:hours|days|pixels|rows|parts|vials)\b"
    return re.sub(
        r"\d+|(?<=[a-z] )[A-Z][a-z]+(?: [A-Z][a-z]+)*|" + units,
        lambda m: other(m[0], number if m[0][0].isdigit() else name if m[0][0].isupper() else lambda: rng.choice(["fortnights", "furlongs", "mg/m³", "°C", "bushels"])), text,
    )


def test_recall_of_planted_new_parameters(spark, sf):
    """Every item of the tables re-parameterised inside a document: recall of 0.95 and no other pair but of like items."""
    rng = random.Random(11)
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    rows = items.select("item_id", "text").collect()
    words = sorted({w for r in rows for w in words_of(r["text"]) if w.isalpha()})
    around = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200").limit(40).collect()]
    planted = [(r["item_id"], rng.choice(around)[:150] + ". " + reparameterised(rng, r["text"], words) + " " + rng.choice(around)[:150]) for r in rows]
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs, items, verbatim=False).collect()}
    found = sum((r["item_id"], r["item_id"]) in got for r in rows)
    assert found >= 0.95 * len(rows)
    # pairs of other items: only of those that are re-parameterisations of each other themselves, or share a long part
    alike = {(r["doc_id"], r["item_id"]) for r in leaks(items.withColumnRenamed("item_id", "doc_id"), items, verbatim=False).collect()}
    assert not {p for p in got if p[0] != p[1]} - alike


def test_many_item_windows_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 3)
    item = " ".join(f"word{chr(97 + i)}" for i in range(20))
    got = leaks(documents(spark, [item, "x " + item, "none of it"]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["verbatim_windows"]) for r in got} == {(1, 9), (2, 9)}


# -- shared spans --------------------------------------------------------------------------------


def brute_pairs(texts, span):
    owners = defaultdict(set)
    for i, t in enumerate(texts, 1):
        for k in range(len(t or "") - span + 1):
            owners[t[k : k + span]].add(i)
    return {(a, b) for held in owners.values() for a in held for b in held if a < b}, owners


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop qrstu .é漢😀"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", "tiny", "-" * 500, "-" * 700, "ab" * 400, "ab" * 300 + text(40)]
    shared = [text(rng.choice([299, 300, 301, 340, 600])) for _ in range(12)]
    footer = text(200)
    for _ in range(70):
        texts.append(text(rng.randrange(0, 300)) + rng.choice(shared) + text(rng.randrange(0, 300)) + rng.choice(["", footer]))
    whole = text(900)
    return texts + [whole, whole, whole, whole[:450], whole + "x", text(40_000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_pairs(spark, seed):
    texts = corpus(seed)
    expected, _ = brute_pairs(texts, 300)
    got = [(r[0], r[1]) for r in shared_pairs(documents(spark, texts)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_groups_hold_the_pairs(spark):
    texts = corpus(5)
    expected, _ = brute_pairs(texts, 300)
    members = defaultdict(list)
    for r in shared_groups(documents(spark, texts)).collect():
        members[r["group_id"]].append((r["doc_id"], r["members"]))
    assert all(len({d for d, _ in held}) == len(held) == n for held in members.values() for _, n in held)
    assert {(a, b) for held in members.values() for a, _ in held for b, _ in held if a < b} == expected


def test_more_candidates_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "LISTED", 3)
    texts = corpus(6)
    assert {tuple(r) for r in shared_pairs(documents(spark, texts)).collect()} == brute_pairs(texts, 300)[0]


def test_shared_lengths(spark):
    texts = corpus(4)
    _, owners = brute_pairs(texts, 300)
    got = {r["doc_id"]: r for r in shared_lengths(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        covered = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - 299):
            if len(owners[t[k : k + 300]]) > 1:
                covered[k : k + 300] = True
        assert got[i]["n_chars"] == len(t or "") and got[i]["shared_chars"] == covered.sum()


def test_shared_nothing(spark):
    assert shared_pairs(documents(spark, ["x"]).limit(0)).count() == 0
    assert shared_pairs(documents(spark, ["a" * 10, None])).count() == 0
    with pytest.raises(ValueError):
        shared_pairs(documents(spark, ["x"]), span=100)
