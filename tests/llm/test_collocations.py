"""Collocations against plain counting, and edge cases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tributary.llm import collocations as own

DOCS = "text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[ \t]", p) if w] for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def expected(rows, least, longest=5, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    found = []
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        longer = [b for (x, q), b in often.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        score, k = min((1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, " ".join(p), a, often[lang, p[:k]], often[lang, p[k:]], n[lang], score))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(out)


def made(r, docs):
    words = ["the", "The", "of", "new", "york", "é", "a\x1cb", "İ", "x-y", "😀", "in", "as", "well"]
    rows = []
    for _ in range(docs):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " as well as "]) for _ in range(r.randint(0, 120)))
        rows.append((text, r.choice(["en", "en", "fr", None, "", "a\tb"])))
    return rows


@pytest.mark.parametrize("block, owned", [(1 << 20, 1 << 22), (50, 100)])
def test_phrases_equal_plain_counts(spark, monkeypatch, block, owned):
    monkeypatch.setattr(own, "BLOCK", block)
    monkeypatch.setattr(own, "OWNED", owned)
    rows = [*made(random.Random(1), 60), (None, "en"), ("", None), (" . \t", "fr"), ("solo", "de")] * 2
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 a", "'clash' rank", "2 doc_id").repartition(4)
    got = sorted(tuple(x) for x in own.collocations(df, least=6).collect())
    assert got == expected(rows, 6) and len({x[0] for x in got}) > 3


def test_overlaps_ties_and_the_top(spark):
    rows = [("a a a a a a b c. b c", "en"), ("x y z", "fr"), ("z y x", "fr")] * 3
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(x) for x in own.collocations(df, least=3, top=4).collect()) == expected(rows, 3, top=4)


def test_common_fingerprints_change_nothing(spark, monkeypatch):
    """Where all fingerprints seem to reach the threshold, as they would if common, rare phrases go by their own counts."""
    rows = made(random.Random(2), 12)
    df = spark.createDataFrame(rows, DOCS)
    want = sorted(tuple(x) for x in own.collocations(df, least=5).collect())
    answers = own._answers
    monkeypatch.setattr(own, "_answers", lambda asked, least: answers(asked, 0))
    assert sorted(tuple(x) for x in own.collocations(df, least=5).collect()) == want == expected(rows, 5)


def test_exact_beyond_64_bits(spark):
    """Scores from counts whose products pass 64 bits, by the operator's own arithmetic."""
    big = [("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12 + 7), ("en", "a b", 2, 10**12 + 1)]
    counts = spark.createDataFrame(big, "lang string, phrase string, k int, a long").select("lang", "phrase", "a", "k")
    totals = spark.createDataFrame([("en", 10**13 + 3)], "lang string, n long")
    own_frequent = own.frequent_phrases
    try:
        own.frequent_phrases = lambda *_: (counts, totals)
        row = own.collocations(counts).first()
    finally:
        own.frequent_phrases = own_frequent
    assert row.score == 1000 * (10**12 + 1) * (10**13 + 3) // (3 * 10**12 * (10**12 + 7))


def test_nothing_and_a_very_long_text(spark):
    assert own.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert own.collocations(spark.createDataFrame([(None, None)], DOCS)).count() == 0
    text = "alpha beta " * 400_000 + "w" * 2_000_000
    got = own.collocations(spark.createDataFrame([(text, "en")], DOCS), least=1000).collect()
    at = lambda k: ["alpha", "beta"] * 400_000 if k % 2 == 0 else []
    counts = {" ".join(at(0)[i : i + k]): 800_000 // 2 - (k - 1 + i) // 2 for k in range(2, 6) for i in (0, 1)}
    assert {x.phrase: x.a for x in got}.items() <= counts.items() and "alpha beta alpha beta alpha" in {x.phrase for x in got}


def test_a_file_of_many_blocks_has_small_row_groups(spark, monkeypatch):
    """Readers take a row group whole: that of all blocks of a task grew with the task."""
    groups, drop = [], own.drop_stored

    def seen(df):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
        groups.append([f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)])
        drop(df)

    monkeypatch.setattr(own, "BLOCK", 1 << 16)
    monkeypatch.setattr(own, "drop_stored", seen)
    r = random.Random(3)
    rows = [(" ".join(str(r.randrange(1 << 30)) for _ in range(60_000)) + ". new york", "en") for _ in range(24)]
    found, totals = own.frequent_phrases(spark.createDataFrame(rows, DOCS).coalesce(1), least=24)
    assert {(x.phrase, x.a) for x in found.collect()} == {("new", 24), ("york", 24), ("new york", 24)}
    assert totals.first().n == 24 * 60_002
    assert sum(groups[0]) > 24 << 20 and max(groups[0]) < 16 << 20


def test_an_owner_adds_up_a_slice_at_a_time(monkeypatch):
    """Sums of equal fingerprints over lists, in slices as in one, holding little beside the lists."""
    r = np.random.default_rng(4)
    ends = np.array([0, 2**64 - 1], np.uint64)
    prints = [np.unique(np.r_[ends, r.integers(0, 2**64, 300, np.uint64) >> np.uint64(57) << np.uint64(57)]) for _ in range(9)] + [ends[:1], ends[1:]]
    n = [r.integers(1, 9, len(x)).astype(np.int32) for x in prints]
    sums = Counter()
    for x, m in zip(prints, n):
        sums.update(dict(zip(x.tolist(), m.tolist())))
    want = [[sums[p] >= 30 for p in x.tolist()] for x in prints]
    assert any(map(any, want)) and not all(map(all, want))
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(own, "SLICE", size)
        assert [x.tolist() for x in own._enough(prints, n, 30)] == want
    many = [np.sort(r.integers(0, 2**64, 1 << 18, np.uint64)) for _ in range(16)]
    ones = [np.ones(len(x), np.int32) for x in many]
    tracemalloc.start()
    try:
        own._enough(many, ones, 100)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20  # one sort of all 4 million held 196 MB
    finally:
        tracemalloc.stop()
