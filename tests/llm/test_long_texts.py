"""Megabyte texts through every operator over documents, beside a short one that must not suffer."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tributary.llm import bpe_transducer, collocations, id_files, license_scan, packing, pii, quality, simhash, suffix_dedup, tagger, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(2, 9))) for _ in range(900)]
    long = " ".join(r.choice(vocabulary) for _ in range(170_000))
    return [long + " write to a.b@mail.example.com under the MIT License.", "short text", long[:1_100_000] + "!" * 3000, "x" * 1_000_000]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], DOCS).repartition(2)


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def test_patterns_and_tagger(frame, texts):
    got = by_id(pii.find(frame, tagger.Tagger(1)))
    assert len(texts[0]) > 10**6 and [got[k].n_email for k in range(4)] == [1, 0, 0, 0]
    at = texts[0].index("a.b@")
    assert f"email:{at}:{at + 20}" in got[0].spans.split(",")


def test_ids_and_packing(spark, frame, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    got = by_id(id_files.read(spark, id_files.write(frame, f"file://{tmp_path}/ids")))
    assert {k: (x.n_tokens, x.ids_crc32) for k, x in got.items()} == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want.items()}
    pieces = packing.pack(frame).groupBy("doc_id").sum("length").collect()
    assert {x.doc_id: x[1] for x in pieces} == {k: len(x) for k, x in want.items()}


def test_byte_bpe_round_trips(frame, texts):
    got = by_id(bpe_transducer.encode(frame))
    assert {k: x.decoded_sha256 for k, x in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}


def test_repeats_and_near_copies(frame, texts):
    got = by_id(suffix_dedup.remove_repeats(frame))
    shared = len(texts[2][:1_100_000].encode()) - 2
    assert got[2].n_removed >= shared - 400 and got[1].n_removed == 0 and got[3].n_bytes == got[3].n_removed == 1_000_000
    prints = by_id(simhash.near_duplicates(frame))
    assert len(prints) == 4 and prints[1].component_id == 1


def test_scores_and_rules(spark, frame):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    assert all(0 <= x.score <= 1 for x in toxicity.score(frame, toxicity.train(frame, labels)).collect())
    got = by_id(quality.judge(frame, quality.train(frame, labels)))
    assert got[0].n_words == 170_007 and got[3].n_words == 1 and got[3].base_failed


def test_licences_and_phrases(frame):
    got = by_id(license_scan.scan(frame))
    assert got[0].n_words >= 170_006 and [m.label for m in got[0].matches] == ["mit"] and not got[1].matches
    assert collocations.collocations(frame, least=2).count() > 0
