"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and a streaming decoder.

Encoding. A segmentation is the BPE encoding of a string exactly when each token encodes to itself and each pair of
neighbours encodes to that pair; so each prefix of a string has one last token. The transducer reads bytes. Its state
holds the longest suffix of the input that begins some token, and for each boundary inside that suffix the last token
there and the tokens since the last emission. Boundaries before that suffix can no longer begin a token and are
dropped; what all boundaries that are left begin with is emitted. So a token leaves once no longer token can
change it, which is after at most the longest token's bytes. Transitions are made when first used and kept.

Decoding. A byte-wise UTF-8 machine carries an incomplete character from token to token, and a token's effect on each
of the machine's states is kept when first used.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, worker_cache

MAX_STATES, MAX_PAIRS, MAX_HOPS = 200_000, 1_000_000, 200_000
MAX_PIECES, MAX_PIECE_CHARS = 900_000, 14_000_000
NONE = 0xFFFFFFFF
BYTES = [bytes((k,)) for k in range(256)]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class Transducer:
    """Compiled from ranks: token bytes -> id; smaller ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """States by number: (suffix, last token by boundary of the suffix, tokens not yet emitted by boundary), from the
        suffix's start to its end. arcs: state * 256 + byte -> (next state, ids emitted)."""
        start = (b"", (NONE,), ((),))
        self.states, self.number = [start], {start: 0}
        self.arcs: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, the definition that the pair test rests on; used for tokens and pairs of them only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the token right may follow the token left (NONE: at the start)."""
        token = self.bytes_of[right]
        if (ok := self.whole.get(right)) is None:
            ok = self.whole[right] = self.merged(token) == [right]
        if ok and left != NONE:
            ok = self.merged(self.bytes_of[left] + token) == [left, right]
        self.pairs[left << 32 | right] = ok
        return ok

    def _arc(self, state: int, byte: int) -> tuple[int, tuple]:
        """The next state and the ids emitted on the way; kept for the next time."""
        suffix, lasts, helds = self.states[state]
        seen = suffix + BYTES[byte]
        rank, fits, k = self.ranks.get, self.pairs.get, 0
        for last in lasts:
            right = rank(seen[k:])
            if right is not None:
                ok = fits(last << 32 | right)
                if ok or ok is None and self._fits(last, right):
                    break
            k += 1
        else:
            raise ValueError("no token ends here; a byte has no rank")
        cut, prefixes, rest = 0, self.prefixes, seen
        while rest not in prefixes:
            cut += 1
            rest = seen[cut:]
        lasts, helds = (*lasts[cut:], right), (*helds[cut:], (*helds[k], right))
        one, done = helds[0], 0
        if one:
            for token in one:
                for held in helds:
                    if len(held) <= done or held[done] != token:
                        break
                else:
                    done += 1
                    continue
                break
            if done:
                helds = tuple([h[done:] for h in helds])
        raw = (rest, lasts, helds)
        to = self.number.get(raw)
        if to is None:
            to = self.number[raw] = len(self.states)
            self.states.append(raw)
        arc = self.arcs[state << 8 | byte] = (to, one[:done])
        return arc

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self._forget()
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        state, out, arcs = 0, [], self.arcs
        for byte in data:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if len(self.states) > 2 * MAX_STATES:  # inside a very long piece
                    raw = self.states[state]
                    self._forget()
                    arcs, state = self.arcs, len(self.states)
                    self.states.append(raw)
                    self.number[raw] = state
                arc = self._arc(state, byte)
            state, got = arc
            if got:
                out += got
        return (*out, *self.states[state][2][-1])


class Utf8:
    """An incremental UTF-8 machine. A state is what an incomplete character still needs: (bytes to come, least and
    most next byte, bits so far); ill-formed bytes give U+FFFD for each maximal part, as the Unicode standard advises."""

    START = (0, 0x80, 0xBF, 0)

    @staticmethod
    def step(state: tuple, byte: int) -> tuple[tuple, str]:
        need, low, high, bits = state
        bad = ""
        if need:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                return ((need - 1, 0x80, 0xBF, bits), "") if need > 1 else (Utf8.START, chr(bits))
            bad = "�"
        if byte < 0x80:
            return Utf8.START, bad + chr(byte)
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, byte & 0x1F), bad
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, byte & 0x0F), bad
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, byte & 0x07), bad
        return Utf8.START, bad + "�"


class Decoder:
    """Streaming: feed() takes ids and gives the characters that are complete; end() the rest of a cut character."""

    def __init__(self, bytes_of: dict[int, bytes], known: dict | None = None):
        self.bytes_of, self.known, self.state = bytes_of, {} if known is None else known, Utf8.START

    def feed(self, ids) -> str:
        out, known, state = [], self.known, self.state
        for i in ids:
            hop = known.get((state, i))
            if hop is None:
                text, at = [], state
                for byte in self.bytes_of[i]:
                    at, got = Utf8.step(at, byte)
                    text.append(got)
                if len(known) >= MAX_HOPS:
                    known.clear()
                hop = known[state, i] = (at, "".join(text))
            state, got = hop
            out.append(got)
        self.state = state
        return "".join(out)

    def end(self) -> str:
        cut, self.state = self.state[0] > 0, Utf8.START
        return "�" * cut


class _Pieces(dict):
    """piece -> ids, by the transducer when first asked for."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.chars = machine, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)
        return ids


class Codec:
    """A worker's encoder of whole texts: distinct pieces pass the transducer once while they stay in a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.pieces, self.known = _Pieces(self.machine), {}
        self.digits = {i: str(i) for i in self.machine.bytes_of}
        #: Tokens that are whole characters: decoded from the machine's start state, they lead back to it.
        self.whole: dict[int, str] = {}
        for i in self.machine.bytes_of:
            d = Decoder(self.machine.bytes_of)
            text = d.feed([i])
            if d.state == Utf8.START:
                self.whole[i] = text

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > MAX_PIECES or self.pieces.chars > MAX_PIECE_CHARS:
            self.pieces = _Pieces(self.machine)
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        texts = list(map(self.whole.get, ids))
        if None not in texts:
            return "".join(texts)
        d = Decoder(self.machine.bytes_of, self.known)
        return d.feed(ids) + d.end()


def codec(ranks_path: str, pattern: str) -> Codec:
    def make() -> Codec:
        with open(ranks_path, "rb") as f:
            return Codec(load_ranks(f.read()), pattern)

    return worker_cache(f"bpe {ranks_path} {pattern}", make)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded of every whole text.

    A narrow map: no shuffle. A null or empty text has no ids; rows of one doc_id, equal ones too, keep a row each, and a
    null doc_id stays null; other columns are not read; an empty table gives no rows. Of equal ranks there are none, so a
    text has one encoding. A very long text is encoded piece by piece and its ids are held whole.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    ranks_path = ranks_path or default_ranks()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = c.encode(text or "")
                back = c.decode(ids)
                row = [doc, len(ids), hashlib.sha256(c.decimal(ids).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                rows.append(row + [ids, back] * with_ids)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
