"""Phrase collocations from vertical positional inverted lists.

Documents are dealt to blocks of about ``BLOCK`` words. Every word of a block has a number, with a gap between pieces of
text, so that what stands one place on is the next word of the same piece. A block's inverted list of a phrase holds the
places where it begins. Merging the places of the frequent phrases with the postings one place on extends each by the
adjacent word; both parts of an extension are frequent phrases. Words are extended unpruned: in a large corpus nearly
every place holds a frequent word, so a pass that drops the others costs more than it saves.

Which extensions are frequent is counted over all blocks. Ranges of fingerprints have an owner each; a block sends every
owner its sorted fingerprints and list lengths of that range, the owner adds up and answers with a bit for each. A common
fingerprint can only let a rare phrase pass, so the lists' lengths, summed by the phrase itself, are exact.

Places and fingerprints are packed bytes to Spark, not arrays of a million elements, and files of blocks have row groups
and pages of a few blocks at most, so a task holds a few blocks however many its file or partition has.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table, worker_cache

LEAST, LONGEST, TOP, BLOCK, OWNED, SLICE, SEED = 100, 5, 2000, 1 << 20, 1 << 22, 1 << 18, 42
#: Lower-cases A-Z, makes what ends a piece a line feed and a tab a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: A block: its phrases as "lang<tab>words", how many places each has, their fingerprints (8 bytes each), the places of one
#: phrase after the other (_packed), and how many these are.
LISTS = pa.schema({"block": pa.int64(), "keys": pa.list_(pa.string()), "n": pa.list_(pa.int32()), "prints": pa.binary(), "places": pa.binary(), "total": pa.int64()})
LISTS_DDL = "block bigint, keys array<string>, n array<int>, prints binary, places binary, total bigint"
#: Readers take a row group whole and writers look at sizes every 100 rows unless told otherwise; a row is a block here.
FILES = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


class _Ids(dict):
    """Numbers words as they are met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Block:
    """Gathers the words of texts."""

    def __init__(self):
        self.langs: dict[str, _Ids] = {}
        self.ids: list[np.ndarray] = []
        self.n = self.held = 0

    def add(self, lang: str, pieces: list[list[bytes]]) -> None:
        ids = self.langs.setdefault(lang, _Ids())
        spot = np.fromiter(
            (i for words in pieces for i in (*map(ids.__getitem__, words), -1)), np.int64, sum(map(len, pieces)) + len(pieces)
        )
        # words of different languages are told apart by the language's number in the high bits
        spot[spot >= 0] |= (list(self.langs).index(lang) if len(self.langs) < 64 else self._number(lang)) << 32
        self.ids.append(spot)
        self.n += len(spot)

    def _number(self, lang: str) -> int:
        if self.held != len(self.langs):
            self.held, self.numbers = len(self.langs), {x: k for k, x in enumerate(self.langs)}
        return self.numbers[lang]

    def lists(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, fingerprints, lengths and places."""
        import xxhash

        ids = np.concatenate(self.ids)
        places = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[places], kind="stable")
        _, n = np.unique(ids[places], return_counts=True)
        # ids of a language count from 0 without gaps, so keys stand in their order
        raw = [lang.encode("utf-8", "surrogatepass") + b"\t" + w for lang, own in self.langs.items() for w in own]
        prints = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in raw), np.uint64, len(raw)).view(np.int64)
        return pa.array(raw, pa.binary()).cast(pa.string()), prints, n.astype(np.int32), places[order].astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed."""
    return pa.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _row(block: int, keys: pa.Array, prints, n, places) -> pa.RecordBatch:
    """One block's row; places go as steps from the list's place before, which are small."""
    steps = places.copy()
    steps[1:] -= places[:-1]
    first = np.cumsum(n)[:-1] if len(n) else np.zeros(0, np.int64)
    steps[first] = places[first]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    flat = [pa.array([x], LISTS.field(c).type) for c, x in (("prints", prints.tobytes()), ("places", _packed(steps)), ("total", len(places)))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(keys), one(pa.array(n, pa.int32())), *flat], schema=LISTS)


def _read(b: pa.RecordBatch, k: int):
    """Fingerprints, lengths and places of row k."""
    n = b.column("n")[k].values.to_numpy(zero_copy_only=False)
    prints = np.frombuffer(b.column("prints")[k].as_buffer(), np.int64)
    # sums may pass 32 bits; places do not, so what wraps around comes back
    total = np.cumsum(_unpacked(b.column("places")[k].as_buffer(), b.column("total")[k].as_py()), dtype=np.int32)
    start = np.cumsum(n, dtype=np.int64) - n
    before = np.where(start > 0, total[start - 1], np.int32(0)) if len(n) else total
    return prints, n, total - np.repeat(before, n)


def _extended(prints: np.ndarray, n: np.ndarray, places: np.ndarray):
    """Phrases one word longer: left and right (places in the lists of their two parts), fingerprints, lengths, places.

    The lists merged by place; where the next posting is one place on, the phrase there ends in the adjacent word.
    """
    here = np.full(int(places.max(initial=0)) + 2, -1, np.int32)  # one phrase at most begins at a place
    here[places] = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0)).astype(np.int32)
    pair = here[at].astype(np.int64)
    pair *= max(len(n), 1)
    pair += here[1:][at]
    del here
    sort = np.argsort(pair, kind="stable")
    pair, at = pair[sort], at[sort]
    del sort
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    left, right = pair[first] // max(len(n), 1), pair[first] % max(len(n), 1)
    x = prints[left].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + prints[right].view(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return left, right, x.view(np.int64), np.diff(np.r_[first, len(pair)]).astype(np.int32), at


def _invert(docs: DataFrame) -> DataFrame:
    """The words' lists of every block."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        worker_cache("collocations", dict)  # nothing is kept here; other operators' caches go
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass").translate(FOLD)
                pieces = [words for piece in data.split(b"\n") if (words := [w for w in piece.split(b" ") if w])]
                while pieces:  # a block may end after any piece
                    total, k = block.n, 0
                    while k < len(pieces) and total < BLOCK:
                        total += len(pieces[k]) + 1
                        k += 1
                    block.add(lang, pieces[:k])
                    pieces = pieces[k:]
                    if block.n >= BLOCK:
                        yield _row(number, *block.lists())
                        block, number = _Block(), number + 1
        if block.n:
            yield _row(number, *block.lists())

    return rows.mapInArrow(run, LISTS_DDL)


def _candidates(b: pa.RecordBatch, k: int, owners: int):
    """Of row k: the extensions sorted by fingerprint: left and right parts, fingerprints, lengths, where each owner's
    range of them begins, and a function for the places, one list after the other, of those that a mask selects."""
    left, right, prints, n, places = _extended(*_read(b, k))
    order = np.argsort(prints.view(np.uint64), kind="stable")
    start, moved, prints = (np.cumsum(n, dtype=np.int64) - n)[order], n[order], prints[order]
    owner = (prints.view(np.uint64) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)

    def placed(mask: np.ndarray) -> np.ndarray:
        size = moved[mask].astype(np.int64)
        return places[np.repeat(start[mask] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    return left[order], right[order], prints, moved, first, owner[first].astype(np.int64), placed


def _asked(lists: DataFrame, owners: int) -> DataFrame:
    """(owner, block, prints, n): what each block sends each owner of a range in which it has extensions, as bytes."""

    def run(batches):
        worker_cache("collocations", dict)
        for b in batches:
            for k in range(b.num_rows):
                _, _, prints, n, first, owner, _ = _candidates(b, k, owners)
                cuts = np.r_[first, len(n)] if len(n) else np.zeros(1, np.int64)
                block = pa.array(np.full(len(first), b.column("block")[k].as_py(), np.int64))
                sent = [
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
                    for x in (prints, n)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(owner), block, *sent], ["owner", "block", "prints", "n"])

    return lists.select("block", "n", "prints", "places", "total").mapInArrow(run, "owner bigint, block bigint, prints binary, n binary")


def _enough(prints: list[np.ndarray], n: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each list of sorted fingerprints: which of them reach least, the lengths n in all lists added up.

    Some SLICE fingerprints, a range of them, are added up at a time: beyond the lists themselves little is held.
    """
    size = sum(map(len, prints))
    low, high = min(int(x[0]) for x in prints), max(int(x[-1]) for x in prints)
    slices = size // SLICE + 1
    edges = np.array([low + (high - low) * s // slices for s in range(1, slices)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(x, edges), len(x)] for x in prints]
    enough = [np.empty(len(x), bool) for x in prints]
    for s in range(slices):
        take = [slice(c[s], c[s + 1]) for c in cuts]
        _, which = np.unique(np.concatenate([x[t] for x, t in zip(prints, take)]), return_inverse=True)
        told = (np.bincount(which, np.concatenate([x[t] for x, t in zip(n, take)])) >= least)[which]
        at = 0
        for x, t in zip(enough, take):
            x[t] = told[at : (at := at + t.stop - t.start)]
    return enough


def _answers(asked: DataFrame, least: int) -> DataFrame:
    """(block, owner, bits): for each of a block's fingerprints, in their order, whether all blocks' lengths reach least."""

    def answer(t: pa.Table) -> pa.Table:
        prints, n = ([np.frombuffer(x.as_buffer(), kind) for x in t[c]] for c, kind in (("prints", np.uint64), ("n", np.int32)))
        bits = [np.packbits(x).tobytes() for x in _enough(prints, n, least)]
        return pa.table({"block": t["block"], "owner": t["owner"], "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("owner").applyInArrow(answer, "block bigint, owner bigint, bits binary")


def _kept(told: DataFrame, owners: int) -> DataFrame:
    """The lists of the extensions that a block was told are frequent (column bits: the owners' answers)."""

    def run(batches):
        import pyarrow.compute as pc

        worker_cache("collocations", dict)
        for b in batches:
            for k in range(b.num_rows):
                left, right, prints, n, first, _, placed = _candidates(b, k, owners)
                answers = sorted(((x["owner"], x["bits"]) for x in b.column("bits")[k].as_py()))
                size = np.diff(np.r_[first, len(n)])
                here = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for (_, x), m in zip(answers, size.tolist(), strict=True)]).astype(bool)
                keys = b.column("keys")[k].values
                names, last = (keys.take(pa.array(x[here])) for x in (left, right))
                names = pc.binary_join_element_wise(names, pc.replace_substring_regex(last, r"(?s)^.*[ \t]", ""), " ")
                yield _row(b.column("block")[k].as_py(), names, prints[here], n[here], placed(here))

    return told.mapInArrow(run, LISTS_DDL)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all phrases of 1 to longest words with a >= least, and (lang, n) of all words.

    lang is "und" where it is null. A null or empty text has no words; rows count each, repeated ones too; other columns
    are not read. Texts are read whole, and a block ends between pieces, so memory is bounded by a block and the longest text.
    """
    lists = stored(_invert(docs), "collocations-words", "zstd", **FILES)
    split = lambda rows: rows.select(
        F.regexp_extract("key", r"(?s)^(.*)\t", 1).alias("lang"), F.regexp_extract("key", r"([^\t]*)$", 1).alias("phrase"), "a"
    )
    summed = lambda df: df.select(F.explode(F.arrays_zip("keys", "n")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.n").alias("a"))
    totals = stored(split(summed(lists)).groupBy("lang").agg(F.sum("a").alias("n")), "collocations-totals")
    frequent = lambda k: stored(split(summed(lists)).where(F.col("a") >= least).withColumn("k", F.lit(k)), f"collocations-frequent-{k}")
    found = [frequent(1)]
    for k in range(2, longest + 1):
        # an owner adds up about OWNED fingerprints, however many blocks send them
        owners = -(-(lists.agg(F.sum("total")).first()[0] or 0) // OWNED) or 1
        answers = _answers(_asked(lists, owners), least).groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("bits"))
        longer = stored(_kept(lists.join(answers, "block"), owners), f"collocations-{k}", "zstd", **FILES)
        drop_stored(lists)
        lists = longer
        found.append(frequent(k))
    drop_stored(lists)
    return reduce(DataFrame.union, found), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each lang's best phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut where floor(1000 a n / (l r)) is least (at the first such place). One that stands in a longer frequent
    phrase that is as frequent goes. Ranked by score and a, both descending, and phrase; an empty table gives no rows.
    """
    counted, totals = frequent_phrases(docs, least, longest)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    phrases = counted.where("k > 1")
    words = F.split("phrase", " ")
    cut = phrases.withColumns({"words": words, "cut": F.explode(F.sequence(F.lit(1), F.col("k") - 1))})
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cut = cut.withColumns({"left": part(F.lit(1), F.col("cut")), "right": part(F.col("cut") + 1, F.col("k") - F.col("cut"))}).drop("words")
    side = lambda name, c: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(c))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    cut = cut.withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_by": wide("l") * wide("r")})
    cut = cut.withColumn("score", F.expr("cast(_up div _by as bigint)"))
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("at"))
    # all shorter phrases inside a phrase, and the most frequent phrase each stands in
    inside = phrases.where("k > 2").withColumn("words", words).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inside = inside.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = inside.groupBy("lang", part(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = weakest.join(inside, ["lang", "phrase"], "left").where("around is null or around < a")
    rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = left.select("lang", "phrase", "a", "at.l", "at.r", "at.n", "at.score")
    return flat.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counted AS (
  SELECT lang, phrase, k, count(*)::BIGINT AS a
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, phrase, k HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, a, k, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS lp, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rp
  FROM counted, range(1, 5) t(cut) WHERE cut < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.lp JOIN counted r ON r.lang = c.lang AND r.phrase = c.rp JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[p:p + s - 1], ' ') AS phrase, max(a) AS around
  FROM counted, range(2, 5) x(s), range(1, 5) y(p) WHERE s < k AND p + s - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
