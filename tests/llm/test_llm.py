"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import bpe_transducer, chat, common, doubling, embedding_dedup, id_files, packing, pii, quality, simhash, suffix_dedup, tagger, toxicity
from tributary.llm.common import components

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\t", "a", "é日本😀", "the the the", "x" * 30_000, "word " * 9_000, "Abc def\x1cghi  <|endoftext|> İΣς ½ don't 12", "\x00\x01"]


def docs(spark, texts, extra=False, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts)
    return df.withColumns({"score": F.lit("clash"), "kept": F.lit(1), "own": F.lit(2.0)}) if extra else df


def words(r, n, k=60):
    stems = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"]
    vocabulary = ["".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(k)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


# ---- token-id files -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_codes_round_trip(n):
    r = np.random.default_rng(n)
    ranks = (2 ** r.uniform(0, 31.9, n)).astype(np.uint32)
    control, data = id_files.pack(ranks)
    assert (id_files.unpack(control, data, n) == ranks).all()
    if n:
        own = id_files.read_block(id_files.write_block(np.arange(2), np.array([n - 1, 1]), ranks, 1))
        assert own[0].tolist() == [0, 1] and own[1].tolist() == [n - 1, 1] and (own[2] == ranks).all() and own[3] == 1


def test_id_files_equal_the_library(spark, library, tmp_path):
    texts = [*ODD, *ODD[:4], *(words(random.Random(k), 200) for k in range(20))]
    path = id_files.write(docs(spark, texts, True), f"file://{tmp_path}/a", file_chars=3000)
    start = 0
    for row, text in zip(id_files.read(spark, path, True).orderBy("doc_id").collect(), texts, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_id_files_empty_repeated_and_null(spark, tmp_path):
    assert id_files.read(spark, id_files.write(spark.createDataFrame([], DOCS), f"file://{tmp_path}/b")).count() == 0
    twice = spark.createDataFrame([(1, "b a"), (1, "a"), (1, "a")], DOCS)
    assert id_files.read(spark, id_files.write(twice, f"file://{tmp_path}/c")).count() == 3


def test_id_files_of_rows_without_doc_id_and_of_one_doc_id(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 40)
    r = random.Random(2)
    rows = [(None, words(r, 9)) for _ in range(5)] + [(7, words(r, 9)) for _ in range(60)] + [(7, "same")] * 30 + [(3, None), (9, "z")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for file_chars in (200, 10**6):
        got = id_files.read(spark, id_files.write(df, f"file://{tmp_path}/e{file_chars}", file_chars=file_chars), True).orderBy("start").collect()
        assert [x.doc_id for x in got] == [3] + [7] * 90 + [9] + [None] * 5
        assert [x.start for x in got] == np.cumsum([0, *(x.n_tokens for x in got)])[:-1].tolist()
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        want = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=key)
        assert sorted(((x.doc_id, x.ids) for x in got), key=key) == want


def test_pieces_equal_the_library(library, monkeypatch):
    from tributary.llm import wordpiece

    r = random.Random(1)
    parts = ["a", "B", "th", "É", "ß", "×", "÷", "À", "Ÿ", "ſ", "œ", "'s", "'", "n't", " ", "  ", "\n", "\t", "\r", "\x0b", "\x00", "\u00a0", "日本", "й", "😀", "0", "12", "½", ".", ",", "<|", "|>", "<|endoftext|>", "<", "|", "é", "İ", "ñ", "Ñ", "Σς", "-", "ª", "µ"]
    encoder = wordpiece.ChunkEncoder(wordpiece.default_path())
    assert encoder.plain
    for lot in (6_000_000, 50, 7):
        monkeypatch.setattr(wordpiece, "LOT", lot)
        monkeypatch.setattr(wordpiece, "MAX_KEPT", 40)
        for _ in range(60):
            texts = [None, *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(8))]
            ids, sizes = encoder.encode(texts)
            want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    encoder.plain = False  # another normaliser: all chunks go to the library
    encoder.clear()
    assert encoder.encode(texts)[0].tolist() == ids.tolist()


# ---- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe_transducer.codec(bpe_transducer.default_ranks(), P.PATTERN)


def test_transducer_equals_the_library(codec):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.machine.ranks, special_tokens={})
    r = random.Random(1)
    alphabet = ["a", "b", "th", "e", " ", "  ", "\n", "日", "й", "é", "0", "😀", "!", "=", "\t", "क", "ing", "tion"]
    for text in [*(t for t in ODD if t is not None), *("".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000))]:
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_streaming_decoder_on_any_bytes(codec):
    r = random.Random(2)
    for _ in range(200):
        data = bytes(r.choice([r.randrange(256), 0xE6, 0x97, 0xA5, 0x41]) for _ in range(50))
        d = bpe_transducer.Decoder(codec.machine.bytes_of)
        ids = codec.machine.encode(data)
        assert "".join([*(d.feed([i]) for i in ids), d.end()]) == data.decode("utf-8", "replace")


def test_bpe_rows(spark):
    got = bpe_transducer.encode(docs(spark, [None, "", "ab"], True), with_ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].decoded == "ab" and got[2].ids_sha256 == hashlib.sha256(",".join(map(str, got[2].ids)).encode()).hexdigest()
    assert bpe_transducer.encode(spark.createDataFrame([], DOCS)).count() == 0


# ---- packing ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 50, 4000, 10**9])
def test_plan_places_every_piece_once(n):
    w = np.exp(-np.arange(1, 257) / 80)
    count = {k + 1: int(c) for k, c in enumerate(np.random.default_rng(1).multinomial(n, w / w.sum())) if c}
    plan = packing.Plan(count, 256, 24)
    assert {k: c for k, c in plan.given.items() if c} == count
    least = -(-sum(k * c for k, c in count.items()) // 256)
    assert least <= plan.sequences <= 1.03 * least + 2


@pytest.mark.parametrize("seed", range(6))
def test_best_plan_is_never_above_best_fit(seed):
    r = np.random.default_rng(seed)
    w = np.exp(-np.arange(1, 257) / r.integers(20, 200))
    count = {k + 1: int(c) for k, c in enumerate(r.multinomial(r.integers(30, 6000), w / w.sum())) if c}
    plan = packing.best_plan(count, 256, 24)
    assert {k: c for k, c in plan.given.items() if c} == count
    least = -(-sum(k * c for k, c in count.items()) // 256)
    whole = packing.Plan(count, 256, 24, 1.0).sequences
    assert least <= plan.sequences <= min(packing.Plan(count, 256, 24, 0.0).sequences, whole)
    assert plan.share == 1.0 if whole == least else True
    assert sum(n for rooms in plan.open.values() for _, n in rooms) <= plan.sequences


def test_packing_is_gapless_and_whole(spark, library):
    r = random.Random(3)
    texts = [*ODD, *(words(r, r.randint(0, 900)) for _ in range(120))]
    got = packing.pack(docs(spark, texts, True), capacity=256, groups=8, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    for doc, rows in got.sort_values("piece").groupby("doc_id"):
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert np.concatenate(rows.ids.tolist()).tolist() == ids and rows.piece.tolist() == list(range(len(rows)))
        assert rows.start.tolist() == list(range(0, len(ids), 256))
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# ---- repeated bytes -----------------------------------------------------------------------------------------------


def removed(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    out = [np.zeros(len(t), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                out[i][p : p + length] = True
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_repeats_equal_brute_force(spark, length):
    r = random.Random(length)
    passages = [words(r, r.randint(8, 60)) for _ in range(8)]
    texts = [None, "", "a" * 900, "ab" * 300, "q" * (length - 1), "w" * length, "v" * (length + 1)]
    for _ in range(90):
        t = words(r, r.randint(0, 40), 400)
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            t += p[r.randint(0, len(p) // 3) : r.randint(2 * len(p) // 3, len(p))] + words(r, r.randint(0, 15), 400)
        texts.append(t)
    texts += texts[7:12]
    got = suffix_dedup.remove_repeats(docs(spark, texts, True), length).orderBy("doc_id").collect()
    raw = [(t or "").encode() for t in texts]
    for row, data, gone in zip(got, raw, removed(raw, length), strict=True):
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("length", [16, 50])
def test_doubling_at_every_position_agrees(spark, length):
    r = random.Random(length)
    passage = words(r, 30)
    texts = [None, "", "q" * (length - 1), "ab" * length, "é" * length] + [words(r, 12, 400) + passage[r.randint(0, 40) : 90] + words(r, 5, 400) for _ in range(30)]
    texts += texts[5:8]
    rows, places = doubling.repeated_strings(docs(spark, texts, True), length)
    covered = [np.zeros(len((t or "").encode()), bool) for t in texts]
    for doc, p in rows.join(places, "row").select("doc_id", "p").collect():
        covered[doc][p : p + length] = True
    raw = [(t or "").encode() for t in texts]
    assert all((a == b).all() for a, b in zip(covered, removed(raw, length), strict=True))
    got = suffix_dedup.remove_repeats(docs(spark, texts), length).orderBy("doc_id").collect()
    assert [x.n_removed for x in got] == [int(c.sum()) for c in covered]


def test_short_repeats_are_told_and_stay(spark):
    r = random.Random(8)
    texts = [None, "", "a" * 90, "b" * 64, "c" * 65]
    for k in range(60):
        t = words(r, 30, 4000)
        if k % 2:
            t = t[:50] + texts[r.randrange(5, len(texts))][40 : 40 + r.randint(20, 95)] + t[50:] if len(texts) > 6 else t
        texts.append(t)
    texts += texts[5:7]
    got = suffix_dedup.remove_repeats(docs(spark, texts, True), 128, short=64).orderBy("doc_id").collect()
    raw = [(t or "").encode() for t in texts]
    for row, whole, half in zip(got, removed(raw, 64), removed(raw, 32), strict=True):
        assert row.n_short_repeats > 0 if whole.any() else True
        assert row.n_short_repeats == 0 if not half.any() else True
    assert sum(x.n_short_repeats > 0 for x in got) > 10 > sum(x.n_removed > 0 for x in got) - 10
    same = spark.createDataFrame([(1, "abc" * 60 + "x")] * 2 + [(None, words(r, 60, 4000)), (2, "y")], DOCS)
    got = suffix_dedup.remove_repeats(same, 128, short=64).orderBy("doc_id").collect()
    assert [g.n_short_repeats > 0 for g in got] == [False, True, True, False] and got[1] == got[2]


def test_many_copies_of_one_row_take_linear_time(spark):
    df = spark.createDataFrame([(1, "word " * 60 + str(k % 1)) for k in range(3000)], DOCS).repartition(4)
    got = suffix_dedup.remove_repeats(df, 40, short=20).agg(F.count(F.lit(1)), F.min("n_removed"), F.max("n_removed")).first()
    assert tuple(got) == (3000, 301, 301)


def test_repeats_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    t = words(random.Random(9), 400, 500)
    one = suffix_dedup.unit_arrays([t.encode()], 40)
    assert one[2].sum() == len(t.encode()) - 39


def test_repeats_of_equal_rows_and_nothing(spark):
    same = spark.createDataFrame([(1, "abc" * 200), (1, "abc" * 200), (None, "xyz")], DOCS)
    got = suffix_dedup.remove_repeats(same, 40).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 600, 600] and got[0].doc_id is None
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    cut = suffix_dedup.without_repeats(same.withColumn("n_chars", F.length("text").cast("long")), 40).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in cut] == [("xyz", 3), ("", 0), ("", 0)]


# ---- SimHash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_links_equal_brute_force(spark):
    r = random.Random(4)
    texts = list(ODD)
    for _ in range(40):
        t = words(r, 150, 500).split()
        for _ in range(4):
            texts.append(" ".join(t))
            t[r.randrange(len(t))] = "new"
    texts += texts[20:30]
    got = simhash.near_duplicates(docs(spark, texts, True)).orderBy("doc_id").collect()
    prints = [plain_fingerprint(t) for t in texts]
    assert [x.fp & (1 << 64) - 1 for x in got] == prints
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [x.component_id for x in got] == [find(k) for k in range(len(texts))]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_find_every_close_pair(spark):
    r = random.Random(6)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for k in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), k)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {tuple(sorted(f & (1 << 64) - 1 for f in x)) for x in simhash.links(df).collect()}
    assert got == {(fps[i], fps[j]) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    counts = lambda f: [(f >> 2 * s & 3).bit_count() for s in range(32)]
    own = [x.u & (1 << 64) - 1 for x in df.select(simhash._popcounts(F.col("fp")).alias("u")).collect()]
    for a, b in [(r.randrange(len(fps)), r.randrange(len(fps))) for _ in range(300)]:
        assert (own[a] ^ own[b]).bit_count() == sum(abs(x - y) for x, y in zip(counts(fps[a]), counts(fps[b]), strict=True))


def test_no_table_of_fingerprints_is_broadcast(spark, tmp_path):
    """Small ones neither, by the planner's own limit, as it only estimates the sizes of large ones."""
    spark.createDataFrame([(k, str(k)) for k in range(50)], DOCS).write.parquet(f"{tmp_path}/d")
    few = spark.read.parquet(f"{tmp_path}/d")
    rows, low = few.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), few.groupBy(F.col("doc_id").alias("a")).agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    met = [common._to_lowest(rows, low, n) for n in (1, common.HOT_LINKS + 1)]
    for df in (simhash.near_duplicates(few), simhash.one_of_each(few), simhash.links(few.select(F.col("doc_id").alias("fp"))), *met):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_rows_without_doc_id_link(spark):
    r = random.Random(2)
    t = [words(r, 60, 300) for _ in range(3)]
    rows = [(None, t[0]), (4, t[0]), (None, t[1]), (None, t[1]), (9, t[2]), (9, t[2]), (9, t[0]), (6, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((x.doc_id, x.component_id) for x in got), key=key) == sorted([(None, 4), (4, 4), (None, None), (None, None), (9, 9), (9, 9), (9, 4), (6, 6)], key=key)


@pytest.mark.parametrize("most", [None, 20])
def test_components_of_a_path_and_a_star(spark, monkeypatch, most):
    if most:  # the star's middle is hot
        monkeypatch.setattr(common, "HOT_LINKS", most)
        monkeypatch.setattr(common, "HOT_SHARE", 0.05)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 1 for k in range(2, 61)) and all(got[k] == 100 for k in range(101, 150))


# ---- embeddings ---------------------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 48)
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base + r.normal(size=base.shape) * 0.08 for _ in range(8)] + [np.tile(base[:1], (90, 1))]).astype(np.float32)
    label = [int(k % 3) for k in range(len(x))]
    rows = [(k, v.tolist(), y) for k, (v, y) in enumerate(zip(x, label, strict=True))]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0] * 15 + [None], 1), (1004, [1.0] * 15 + [float("nan")], 1), (1005, x[0].tolist(), None), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("weight", F.lit(3))
    got = {g.vec_id: g for g in embedding_dedup.link(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    true = near.sum() - len(x)
    found = sum(got[k].n_links for k in range(len(x)))
    assert all(got[k].n_links <= near[k].sum() - 1 for k in range(len(x))) and found >= 0.97 * true
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1000, 1006))
    assert got[1006].n_links == 1 and got[1007].component_id == 1006
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_vectors_of_one_or_no_vec_id(spark):
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(5, x, 1), (6, x, 1), (5, y, 2), (7, y, 2), (None, x, 1), (None, [0.0, 0.0, 1.0], 1), (9, x, 3), (9, x, 3)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)).collect()
    key = lambda r: [(v is None, v or 0) for v in r]
    want = [(5, 2, 5, True), (6, 2, 5, False), (None, 2, 5, False), (5, 1, 5, True), (7, 1, 5, False), (None, 0, None, True), (9, 1, 9, True), (9, 1, 9, True)]
    assert sorted((tuple(g) for g in got), key=key) == sorted(want, key=key)


def test_rare_lengths_have_trees_too(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    r = np.random.default_rng(2)
    base = r.normal(size=(50, 8))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, number = embedding_dedup.Forest(np.zeros((0, 8)), 100).leaves(x)
    of = [set(number[row == k].tolist()) for k in range(100)]
    assert np.mean([bool(of[k] & of[50 + k]) for k in range(50)]) > 0.95 and max(np.unique(number, return_counts=True)[1]) < 60


# ---- toxicity, quality --------------------------------------------------------------------------------------------


def labelled(n=900):
    r = random.Random(8)
    texts, bad = [], []
    for k in range(n):
        t = words(r, 60, 300).split()
        if k % 5 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["idiot", "moron,", "Scum"]))
        texts.append(" ".join(t))
        bad.append(int(k % 5 == 0))
    return texts, bad


def test_toxicity_on_held_out_rows(spark):
    texts, bad = labelled()
    df = docs(spark, texts, True)
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(bad)] + [(5000, 1, 1), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(df, labels)
    got = toxicity.score(df, machine).orderBy("doc_id").collect()
    held = [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(len(texts))]
    assert np.mean([g.predicted == y for g, y, h in zip(got, bad, held, strict=True) if h]) > 0.97
    odd = toxicity.score(docs(spark, ODD), machine).collect()
    assert all(0 <= g.score <= 1 for g in odd) and not any(g.predicted for g in odd)
    empty = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df, empty).agg(F.max("score")).first()[0] < 0.01


def test_scores_equal_a_plain_sum_over_pairs():
    """Brute force: every term's weight and every pair's inner product, one by one."""
    r = np.random.default_rng(4)
    known_words = [b"alpha", b"beta", b"gamma", b"deltas", b"e"]
    terms = sorted({t for w in known_words for t in toxicity.terms_of(w)})
    m = toxicity.Machine(terms, 0.3, r.normal(size=len(terms)), r.normal(size=(len(terms), toxicity.FACTORS)))
    for text in ["", None, "alpha", "Alpha, beta! GAMMA", "alpha alpha deltas e unknown", "deltas gamma beta alpha e"]:
        own = {t for w in re.findall("[a-z]+", (text or "").lower()) for t in toxicity.terms_of(w.encode())}
        at = [terms.index(t) for t in own if t in terms]
        x = 0.3 + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i in at for j in at if i < j)
        assert m.score(text, {}) == pytest.approx(1 / (1 + np.exp(-x)))


def test_path_lengths_equal_walks():
    """Brute force: each row walks each tree on its own."""
    r = np.random.default_rng(5)
    forest = quality.Forest(r.normal(size=(300, quality.SHARES)))
    data = np.concatenate([r.normal(size=(20, quality.SHARES)), 9 * np.ones((1, quality.SHARES))])
    for row, score in zip(data, forest.score(data), strict=True):
        lengths = []
        for t in range(quality.TREES):
            k = 0
            while forest.feature[t, k] >= 0:
                k = forest.left[t, k] + (row[forest.feature[t, k]] >= forest.split[t, k])
            lengths.append(forest.length[t, k])
        assert score == pytest.approx(2 ** (-np.mean(lengths) / forest.usual))
    assert forest.score(data)[-1] == forest.score(data).max()
    one = quality.Judge(data[:1], np.array([True]))
    assert one.forest is not None and one.kept(data[:1])[0].tolist() == [True]


def test_learned_operators_on_repeated_rows(spark):
    texts, bad = labelled(300)
    rows = list(enumerate(texts)) + [(1, texts[1])] * 400 + [(None, "x")] * 3
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(k, 1 - y, y) for k, y in enumerate(bad)] * 2, "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.train(df, labels)).count() == len(rows)
    assert quality.judge(df, quality.train(df, labels)).count() == len(rows)
    for made in (toxicity.score(df.limit(0), toxicity.Machine()), quality.judge(df.limit(0), quality.train(df.limit(0), labels))):
        assert made.count() == 0


def test_pairs_of_terms_weigh_more_than_parts():
    r = random.Random(0)
    sets, y = [], []
    for k in range(600):
        a, b = k % 2, k // 2 % 2
        sets.append(np.array(sorted(([1] if a else []) + ([2] if b else []) + r.sample(range(10, 900), 4)), np.int32))
        y.append(a & b)
    m = toxicity.fit(sets, np.array(y))
    v, p = m.factors, m.place
    assert v[p[1]] @ v[p[2]] > 0


def test_quality_counts_and_verdicts(spark):
    def plain(t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(hit)]

    r = random.Random(3)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    good = [words(r, 80, 300) + ".\n" + words(r, 20, 300) for _ in range(200)]
    junk = [re.sub(" ", "*** ", words(r, 80, 300)) for _ in range(40)]
    texts += good + junk + ["a b\na b\n \n\na b", words(r, 12, 300) + " " + "one two three four five six " * 5]
    df = docs(spark, texts, True)
    n = len(texts) - len(good) - len(junk) - 2
    labels = spark.createDataFrame([(n + k, int(k < len(good)), 0) for k in range(len(good) + len(junk))], "doc_id long, quality int, toxic int")
    got = quality.judge(df, quality.train(df, labels)).orderBy("doc_id").collect()
    assert [[g[c] for c in quality.COUNTS] for g in got] == [plain(t) for t in texts]
    assert all(g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words) for g in got)
    assert np.mean([g.kept for g in got[n : n + 200]]) > 0.97 and not any(g.kept for g in got[n + 200 : n + 240])
    assert quality.judge(df, quality.train(df, labels.limit(0))).where("kept = base_failed").count() == 0


# ---- personal data ------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_equal_plain_ones():
    r = random.Random(2)
    parts = ["@", ".", "-", " ", "+", "(", ")", "1", "22", "4111", "255", "a", "b.c", "_", "é", "\n", "4111111111111111", "1.2.3.4"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@x.y") == [(0, 0, 100_004)]


def test_gradients():
    r = np.random.default_rng(0)
    t = tagger.Tagger()
    x, y = r.integers(0, tagger.CLASSES, (9, 3)).astype(np.uint8), r.integers(0, tagger.TAGS, (9, 3))
    _, g = t.loss(x, y)
    for k, v in t.p.items():
        at = tuple(r.integers(0, s) for s in v.shape)
        own = v[at]
        v[at] = own + 1e-2
        up, _ = t.loss(x, y)
        v[at] = own - 1e-2
        down, _ = t.loss(x, y)
        v[at] = own
        assert g[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_best_path_equals_all_paths():
    from itertools import product

    t = tagger.Tagger(2)
    r = np.random.default_rng(3)
    parts = [r.normal(size=(n, tagger.TAGS)).astype(np.float32) for n in (1, 3, 4, 2)]
    for e, got in zip(parts, t.viterbi(parts), strict=True):
        worth = lambda path, e=e: sum(e[k, y] for k, y in enumerate(path)) + sum(t.p["trans"][a, b] for a, b in zip((0, *path), (*path, 0), strict=True))
        assert worth(got.tolist()) == pytest.approx(max(map(worth, product(range(tagger.TAGS), repeat=len(e)))), abs=1e-5)


def trained(spark, texts):
    return pii.train(docs(spark, texts))


@pytest.fixture(scope="module")
def tagging(spark):
    """A tagger, and texts of other words with planted spans that are no pattern: (text, kind, string)."""
    r = random.Random(5)
    texts = [words(r, 120, 200) for _ in range(200)]
    for k in range(0, 200, 3):
        texts[k] = texts[k][:200] + " +1 (555) 010-44" + f"{k:02d} " + texts[k][200:] + f" x{k}@mail.example.com"
    model = trained(spark, texts)
    planted = []
    for k in range(900):
        kind, string, before, after = 0, "", "", ""
        while not kind or plain_spans(string):
            kind, string, before, after = pii._made(r)
        if kind == 3 and not pii.plausible(2, string):  # a made card number seldom passes Luhn
            continue
        text = words(r, 110, 200)
        cut = text.index(" ", r.randrange(20, len(text) - 40))
        text = f"{text[:cut]} {before}{string}{after}{text[cut:]}"
        at = cut + 1 + len(before)
        planted.append((text, kind - 1, at, at + len(string)))
    return model, planted


def test_tagger_adds_what_patterns_miss(spark, tagging):
    model, planted = tagging
    found = pii.all_spans(model, [t for t, *_ in planted])
    hit = [any(a < z and s < e and own == kind for a, own, e in every) for (_, kind, s, z), (_, every) in zip(planted, found, strict=True)]
    extra = [x for (_, kind, s, z), (base, every) in zip(planted, found, strict=True) for x in set(every) - set(base)]
    right = sum(any(x[0] < z and s < x[2] for x in every) for (_, _, s, z), (_, every) in zip(planted, found, strict=True))
    assert np.mean(hit) > 0.9 and right / max(len(extra), 1) > 0.9
    r = random.Random(9)
    plain = [words(r, 200, 300) + " in 2019, 3:15, version 2.4.1, 12 000 pages, 1.5 or 20-30" for _ in range(60)]
    assert sum(len(every) for _, every in pii.all_spans(model, plain)) == 0


def test_find_and_mask(spark, tagging):
    model, planted = tagging
    texts = [*ODD, "1" * 5_000 + " +1 (555) 010-4477", *(t for t, *_ in planted[:60])]
    got = pii.find(docs(spark, texts, True), model).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        base = plain_spans(text or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        spans = [x for x in row.spans.split(",") if x]
        assert {f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base} <= set(spans)
        assert row.n_spans == len(spans) == len(base) + row.n_added
    same = spark.createDataFrame([(1, "call +1 (555) 010-4477"), (1, "call +1 (555) 010-4477"), (None, "b@c.de")], DOCS)
    assert [(x.doc_id, x.n_spans) for x in pii.find(same, model).orderBy("doc_id").collect()] == [(None, 1), (1, 1), (1, 1)]
    assert pii.find(same.limit(0), model).count() == 0 and pii.find(same, pii.train(same.limit(0))).count() == 3
    masked = pii.mask(docs(spark, [None, "to x1@mail.example.com now"]), model).orderBy("doc_id").collect()
    assert masked[0].text is None and masked[1].text == "to <EMAIL> now"


def test_windows_do_not_change_the_result():
    model = tagger.Tagger(1)
    texts = ["", "a", words(random.Random(1), 500, 100), "call 555-0100 " * 60]
    one = [pii.added_spans(model, [t], True)[0] for t in texts]
    assert pii.added_spans(model, texts, True) == one


def test_windows_without_a_trigger_add_nothing(tagging):
    """The spans that pass the check, with windows left out and with all: planted forms, keys without a digit, long runs."""
    model, planted = tagging
    r = random.Random(4)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    keys = [of("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + more, r.randint(12, 40)) + r.choice(["", "", "=", "=="]) for more in ("_", "-/", "_+-/") for _ in range(130)]
    keys += [of("abcdefghijklmnopqrstuvwxyz_", r.randint(90, 190)) + r.choice(["7", "7a", "="]) for _ in range(60)]
    texts = [words(r, 300, 200) + t + words(r, 300, 200) + "7" * r.choice([0, 1, 700]) for t, *_ in planted[:150]]
    texts += [f"{words(r, 90, 200)} {r.choice(pii._KEYS)}: {key} {words(r, 90, 200)}" for key in keys]
    for some in (model, tagger.Tagger(3)):
        part, whole = pii.added_spans(some, texts), pii.added_spans(some, texts, True)
        assert all(set(a) <= set(b) for a, b in zip(part, whole, strict=True))
        assert pii.all_spans(some, texts) == pii.all_spans(some, texts, True)
    assert sum(bool(every) for _, every in pii.all_spans(model, texts[150:])) > 100


def test_spans_equal_one_run_over_the_whole_text(tagging):
    """Brute force: the network over all of a text at once. Its states forget, so windows agree where context suffices."""
    model, planted = tagging
    agree = total = 0
    for text, *_ in planted[:60]:
        x = tagger.classes(text)
        whole = model.emissions(np.ascontiguousarray(x[:, None]))[:, :, 0]
        (tags,) = model.viterbi([whole])
        edge = np.nonzero(np.diff(np.concatenate([[0], tags, [0]])))[0].tolist()
        want = {(s, int(tags[s]) - 1, t) for s, t in zip(edge[:-1], edge[1:], strict=True) if tags[s]}
        got = set(pii.added_spans(model, [text], True)[0])
        agree, total = agree + len(want & got), total + len(want | got)
    assert agree >= 0.98 * total > 0


def test_tagger_has_its_full_size():
    assert tagger.Tagger().p["emb"].shape[0] == 8 and tagger.Tagger().p["out"].shape[1] == 2 * 16


def test_every_character_has_24_of_context_on_both_sides():
    class Marked(tagger.Tagger):
        """An e-mail where an @ stands 24 characters before and a # 24 after, if both lie in the window."""

        def emissions(self, x):
            e = np.zeros((len(x), tagger.TAGS, x.shape[1]), np.float32)
            e[24:-24, 1] = np.where((x[:-48] == tagger.classes("@")) & (x[48:] == tagger.classes("#")), 9, -9)
            e[:24, 1] = e[-24:, 1] = e[:, 2:] = -9
            return e

    model = Marked(1)
    model.p["trans"][:] = 0
    for at in range(24, 700):
        text = ("a" * (at - 24) + "@" + "a" * 47 + "#").ljust(900, "a")
        assert pii.added_spans(model, [text], True) == [[(at, 0, at + 1)]], at


# ---- chat ---------------------------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    convs = {1: full[:1], 2: full[:2], 3: full, 4: full, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)], 7: [("user", "hi\x1f")]}
    rows = [(c, k, role, text) for c, ts in convs.items() for k, (role, text) in enumerate(ts)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(0))
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {3, 5, 6, 7} and got[3].n_equal == 2 and got[3].n_turns == 3
    assert got[5].text == "<|user|>\nhi<|end|>\n<|assistant|>\nother<|end|>\n"
    assert chat.collapse(df.limit(0)).count() == 0


def test_turns_cannot_run_into_each_other(spark):
    rows = [(1, 0, "a", "b\x1f5\x1ft"), (2, 0, "a\x1f1\x1fb", "t"), (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 0, "a", "b"), (5, 0, "a", "b"), (6, 0, "a", "b"), (7, None, None, None), (8, None, "", "")]
    rows += [(9, k, "user", f"turn {k}") for k in range(3000)] + [(10, k, "user", f"turn {k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat.collapse(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (2, 1), 7: (1, 2), 9: (3000, 1)}


def test_transducer_forgets_inside_a_long_piece(codec, monkeypatch):
    r = random.Random(7)
    data = "".join(r.choice("abcdefghijklmnop") for _ in range(3000)).encode()
    whole = bpe_transducer.Transducer(codec.machine.ranks)
    ids = whole.encode(data)
    monkeypatch.setattr(bpe_transducer, "MAX_STATES", 20)
    assert bpe_transducer.Transducer(codec.machine.ranks).encode(data) == ids
    assert b"".join(whole.bytes_of[i] for i in ids) == data
