"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

File format. A file is a Parquet container of blocks in ascending document order; each row is one block:
``part`` (file number), ``before`` (ids of the file that stand before it), ``n_ids`` and ``payload``. A payload is

    magic b"TRB2" | n_docs u32 | n_null u32 | n_ids u64 | doc ids i64[n_docs] | lengths u32[n_docs]
    | control bytes ceil(n_ids / 4) | data bytes

where the last n_null documents have no doc_id (0 takes its place).

Each id is replaced by its frequency rank over the whole corpus (0 is the most frequent), written in 1 to 4 bytes,
little end first. Four 2-bit codes (bytes - 1, lowest bits first) make a control byte; the control bytes stand apart
from the data, so a table of 256 entries gives the widths of four ids at once. The ranks' ids are a small table of
their own beside the blocks (``rank``, ``id``); its size is bounded by the tokenizer's vocabulary.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, shared_dir, stored, table, worker_cache
from .wordpiece import LOT, default_path, encoder

MAGIC, HEAD = b"TRB2", struct.Struct("<IIQ")
BLOCK_IDS = 100_000
#: Characters of a file, while there are MOST_FILES at most; beyond that files grow up to LARGE_CHARS.
FILE_CHARS, MOST_FILES, LARGE_CHARS = 12_000_000, 4096, 256_000_000

#: For each control byte, the widths of its four values; then the offsets of the four and their sum.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    n = len(ranks)
    raw = np.ascontiguousarray(ranks, dtype="<u4")
    code = ((raw > 0xFF).astype(np.uint8) + (raw > 0xFFFF) + (raw > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), raw.view(np.uint8).reshape(n, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by table lookup of the control bytes."""
    widths = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(widths) - widths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.nonzero(widths > k)[0]
        if not len(wide):
            break
        out[wide] |= raw[start[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, n_null: int = 0) -> bytes:
    control, data = pack(ranks)
    head = MAGIC + HEAD.pack(len(doc_ids), n_null, len(ranks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), control, data])


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, lengths and ranks of a block, and how many documents at its end have no id."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_null, n = HEAD.unpack_from(payload, 4)
    at = 4 + HEAD.size
    docs = np.frombuffer(payload, "<i8", n_docs, at)
    lengths = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs)
    at += 4 * n_docs
    control = payload[at : at + -(-n // 4)]
    return docs, lengths, unpack(control, payload[at + len(control) :], n), n_null


def _with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    lengths = sizes + 1
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = ids
    return out, lengths


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, vocab: int = 1 << 16, file_chars: int = FILE_CHARS) -> str:
    """Encodes every whole text of docs (doc_id, text) and writes blocks and ranks under path, in ascending doc_id order.

    Null and empty texts have the end id alone; rows of one doc_id, equal ones too, keep a row each, by a hash of the
    text; rows with a null doc_id stand last. Other columns are not read. A very long text is encoded in lots and may
    fill a block of its own. An empty table gives no blocks. Rows are dealt by ranges of (doc_id, hash of text, row
    number), so that a doc_id with a third of all rows takes several files, and encoded once, to plain blocks; ids are
    counted over all of these (each task counts into an array of the vocabulary's size), and then the blocks are coded
    by rank, file by file.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    narrow = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")
    block = "part int, before long, n_ids long, payload binary"

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        waiting: list[tuple] = []
        size = large = 0

        def flush():
            nonlocal held, size, before
            doc_ids, lengths, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
            n_null = sum(x[3] for x in held)
            payload = struct.pack("<II", len(doc_ids), n_null) + b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), ids.astype(narrow).tobytes()])
            held, size, before = [], 0, before + len(ids)
            cols = [pa.array([part], pa.int32()), pa.array([before - len(ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "before", "n_ids", "payload"])

        def encoded():
            """What waits, in blocks' worth of documents."""
            nonlocal waiting, large
            doc_ids, texts = (pa.concat_arrays([x[k] for x in waiting]) for k in (0, 1))
            waiting, large = [], 0
            ids, lengths = _with_end(*encoder(tokenizer).encode(texts), end_id)
            ends = np.cumsum(lengths)
            number, missing = doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False)
            a = 0
            while a < len(lengths):
                done = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, done + BLOCK_IDS, "right")))
                yield number[a:z], lengths[a:z], ids[done : int(ends[z - 1])], int(missing[a:z].sum())
                a = z

        def blocks():
            nonlocal size
            for some in encoded():
                if held and size + len(some[2]) > BLOCK_IDS:
                    yield flush()
                held.append(some)
                size += len(some[2])

        for b in batches:
            waiting.append((b.column(0), b.column(1)))
            large += b.column(1).nbytes
            if large >= LOT:
                yield from blocks()
        if waiting:
            yield from blocks()
        if held:
            yield flush()

    def plain(payload):
        n, n_null = struct.unpack_from("<II", payload)
        return np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<u4", n, 8 + 8 * n), np.frombuffer(payload, narrow, -1, 8 + 12 * n), n_null

    def count(batches):
        worker_cache("ids", dict)  # the encoder goes
        seen = np.zeros(vocab, np.int64)
        for b in batches:
            for payload in b.column(0):
                seen += np.bincount(plain(payload.as_buffer())[2], minlength=vocab)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["id", "n"])

    def code(batches):
        worker_cache("ids", dict)  # the encoder goes
        for b in batches:
            for k in range(b.num_rows):
                doc_ids, lengths, ids, n_null = plain(b.column(3)[k].as_buffer())
                out = pa.array([write_block(doc_ids, lengths, ranks.value[ids], n_null)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in range(3)), out], ["part", "before", "n_ids", "payload"])

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // LARGE_CHARS), min(-(-chars // file_chars), MOST_FILES))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("own"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), "own", "row"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    raw = stored(ordered.mapInArrow(encode, block), "ids", "zstd")
    counts = raw.select("payload").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted((-n, i) for i, n in counts)
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[[i for _, i in order]] = np.arange(len(order))
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)
    raw.mapInArrow(code, block).write.parquet(f"{path}/blocks")
    drop_stored(raw)
    return path


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files under path: doc_id, start, n_tokens, ids_crc32 and, with_ids, the ids.

    start counts the ids of all documents before it in file order. One number for each file comes to the driver: at
    most MOST_FILES, or one for each LARGE_CHARS characters of a larger corpus (8 bytes each, 3 MB for 100 TB).
    """
    ids = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    ids_of = spark.sparkContext.broadcast(ids)
    frame = spark.read.parquet(f"{path}/blocks")
    sums = frame.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()
    held = sums["n"].to_numpy()
    bases = spark.sparkContext.broadcast((sums["part"].to_numpy(), np.cumsum(held) - held))

    def decode(batches):
        worker_cache("ids", dict)
        for b in batches:
            for part, before, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs, lengths, ranks, n_null = read_block(payload.as_py())
                values = ids_of.value[ranks].astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                crcs = [zlib.crc32(values[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = int(bases.value[1][np.searchsorted(bases.value[0], part)])
                named = pa.array(docs, mask=np.arange(len(docs)) >= len(docs) - n_null)
                cols = [named, pa.array(starts + base + before), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return frame.select("part", "before", "payload").mapInArrow(decode, schema)


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = write(docs, f"{shared_dir(spark)}/tributary/ids-{uuid.uuid4().hex}")
    return read(spark, path)
