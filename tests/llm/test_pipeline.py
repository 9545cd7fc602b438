"""The corpus pipeline against a brute-force version of its stages, on a small table."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tributary.llm import pii, toxicity  # noqa: E402

from test_llm import plain_fingerprint, removed, words  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    passage = words(r, 110, 300)
    texts = []
    for k in range(240):
        t = words(r, r.randint(30, 120), 300).split()
        if k % 6 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["idiot", "moron", "scum"]))
        if k % 7 == 0:
            t += passage.split()
        if k % 8 == 0:
            t.append(f"write x{k}@mail.example.com")
        texts.append(" ".join(t))
    texts += [texts[1], texts[2] + " ", "", None]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 6 == 0)) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(enumerate(texts))


def test_pipeline_equals_its_stages(spark, corpus):
    from tokenizers import Tokenizer

    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = {k: t for k, t in texts.items() if machine.score(t, {}) < toxicity.THRESHOLD}
    assert {k for k in range(240) if k % 6 == 0}.isdisjoint(left) and len(left) > 190

    prints = {k: plain_fingerprint(t) for k, t in left.items()}
    root = {k: k for k in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    left = {k: left[k] for k in sorted(left) if find(k) == k}
    assert 240 not in left and 241 not in left

    raw = [(t or "").encode() for t in left.values()]
    gone = removed(raw, 400)
    left = {k: (t if t is None else bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore")) for (k, t), b, g in zip(left.items(), raw, gone, strict=True)}
    assert sum(map(np.sum, gone)) > 0

    rows = [(k, t, "en", "s", len(t or "")) for k, t in left.items()]
    tagger = pii.train(spark.createDataFrame(rows, docs.schema))
    masked = {k: pii.masked(t or "", pii.all_spans(tagger, [t])[0][1]) for k, t in left.items()}
    assert not any("@mail" in t for t in masked.values())

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in masked.items()}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert {(d, p): n for d, p, n in zip(got.doc_id, got.piece, got.length, strict=True)} == {
        (k, p): min(2048, len(x) - 2048 * p) for k, x in ids.items() for p in range(-(-len(x) // 2048))
    }
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()


def test_every_stage_but_the_last_keeps_the_columns(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_null_and_repeated_doc_ids_lose_only_copies(spark, corpus):
    folder, _ = corpus
    r = random.Random(8)
    texts = [words(r, 60, 300) for _ in range(40)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    copies = [(None, texts[0], "de", "s", 1), (None, texts[1], "en", "s", 1), (999, texts[2], "en", "s", 1), (3, texts[3], "en", "s", 1), rows[6], rows[7], (50, None, "en", "s", 0), (None, "", "en", "s", 0)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted([*rows[:3], copies[3], *rows[4:], copies[6]], key=repr)
    want[want.index(rows[0])] = copies[0]  # null doc_ids, one text: the smaller lang
    for parts in (1, 5):
        df = spark.createDataFrame([*rows, *copies], docs.schema).repartition(parts)
        got = [tuple(x) for x in corpus_pipeline.drop_near_copies(spark, df, folder).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_passages_of_some_fifty_words_go(spark, corpus):
    """They have less than op4's 400 bytes; what stands around them stays."""
    folder, _ = corpus
    r = random.Random(5)
    passages = [words(r, 52, 300) for _ in range(8)]
    passages = [p for p in passages if 256 <= len(p.encode()) < 400]
    assert len(passages) > 3
    around = [words(r, 40, 300) for _ in range(4 * len(passages))]
    texts = [f"{around[2 * k]} {passages[k % len(passages)]} {around[2 * k + 1]}" for k in range(2 * len(passages))] + [words(r, 90, 300)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_bytes(spark, docs, folder).collect()}
    for k in range(len(texts) - 1):
        assert passages[k % len(passages)][2:-2] not in got[k] and len(got[k]) < 400 + len(texts[k]) - 256
        # neighbours of two copies may agree in a few bytes more
        assert got[k].startswith(around[2 * k][:-5]) and got[k].endswith(around[2 * k + 1][5:])
    assert got[len(texts) - 1] == texts[-1]
