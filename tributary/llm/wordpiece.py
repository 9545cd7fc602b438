"""Encoding with a public word-level BPE file through the tokenizers library, each distinct piece once.

The normaliser and the splitter of that file never look across white space, so a text's ids are those of its chunks
between blanks, joined. Most chunks are plain: ASCII and letters of Latin-1, no apostrophe, no start of a special token.
Numpy lower-cases them and splits them into pieces (runs of letters, digits, runs of signs), as the file says, on the
Arrow bytes of many texts at once; any other chunk stays whole. Arrow's dictionary gives the distinct pieces and chunks.
The library merges new pieces, many in a call, and takes whole chunks through all of its steps; frequent ones are kept
from one lot of texts to the next. Ids are then gathered by numpy. If the file's normaliser or splitter is another one,
every chunk goes to the library.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import worker_cache

#: What is kept is begun anew beyond so many pieces or characters of them (about 40 MB).
MAX_KEPT, MAX_CHARS = 150_000, 3_000_000
#: A piece is kept if one lot of texts holds it so often.
FREQUENT = 3
#: Texts are encoded in lots of about so many bytes; longer ones are cut at blanks. Ids are gathered so many at a time.
LOT, GATHER = 6_000_000, 500_000

#: What the fast way above stands for.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Classes of bytes: blanks part chunks; letters are a-z, A-Z and the two bytes of U+00C0 to U+00FF.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = SIGN
    kind[[9, 10, 13, 32]], kind[ord("'")] = BLANK, ODD
    kind[48:58] = DIGIT
    for a in (65, 97):
        kind[a : a + 26] = LETTER
    kind[0xC3] = kind[0x80:0xC0] = LETTER  # a lead byte but C3 makes its chunk odd
    lower[65:91] += 32
    return kind, lower


KIND, LOWER = _classes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        split = bare["pre_tokenizer"]["pretokenizers"]
        self.plain = (bare["normalizer"] or {}).get("normalizers") == NORMALIZER and split[0]["pattern"] == {"Regex": SPLITTER}
        suffix, vocab = bare["model"]["end_of_word_suffix"], bare["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        bare["normalizer"], split[0] = None, {"type": "WhitespaceSplit"}
        self.merges = Tokenizer.from_str(json.dumps(bare)) if self.plain else None
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces: index gives a piece's row, and rows are flat[start[k] : start[k] + length[k]]."""
        self.index, self.chars = {}, 0
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.length, self.flat = np.concatenate([self.length, sizes]), np.concatenate([self.flat, ids])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of lower-case pieces, merged in one call, in which the last id of each carries the end of a word."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.nonzero(self.ends[ids])[0] + 1
        if len(ends) != len(pieces):
            raise ValueError("a piece without one end of a word")
        return ids, np.diff(ends, prepend=0)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of any chunks."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        found = [e.ids for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _lot(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in data of pieces (or chunks), their ids joined, and the sizes. first: places where a text begins."""
        kind = KIND[data]
        inner = kind != BLANK
        chunk = inner.copy()
        chunk[1:] &= ~inner[:-1]
        first = first[first < len(data)]
        chunk[first] = inner[first]
        if self.plain:
            start, low = inner & (kind == DIGIT), LOWER[data]
            start[1:] |= (kind[1:] != kind[:-1]) & inner[1:]
            start |= chunk
            lead = np.nonzero(data[:-1] == 0xC3)[0]
            second = data[lead + 1]
            low[lead[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20
            odd = np.concatenate([np.nonzero(kind == ODD)[0], lead[(second == 0x97) | (second == 0xB7)], np.nonzero((data[:-1] == 60) & (data[1:] == 124))[0]])
        else:
            start, low, odd = chunk, data, np.zeros(0, np.int64)
        is_odd = np.zeros(0, bool)
        if len(odd):
            begin = np.nonzero(chunk)[0]
            own = np.unique(np.searchsorted(begin, odd, "right") - 1)
            end = np.append(begin, len(data))[own + 1]
            step = np.zeros(len(data) + 1, np.int8)
            step[begin[own]] = 1
            np.subtract.at(step, end, 1)
            inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            start &= ~inside | chunk
            low[inside] = data[inside]
            is_odd = inside[start]
        ends = np.append(np.nonzero(start[inner])[0], np.count_nonzero(inner)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(low[inner])).dictionary_encode()
        words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        whole = np.full(len(words), not self.plain)
        if len(is_odd):
            whole[number[is_odd]] = True
        row = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = row >= 0
        at[old], length[old] = self.start[row[old]], self.length[row[old]]
        often = np.bincount(number, minlength=len(words)) >= FREQUENT
        flat = [self.flat]
        for some, encode in ((~old & ~whole, self._pieces), (~old & whole, self._library)):
            some = np.nonzero(some)[0]
            for k in range(0, len(some), 20_000):
                own = some[k : k + 20_000]
                ids, sizes = encode([words[i] for i in own])
                at[own], length[own] = sum(map(len, flat)) + np.cumsum(sizes) - sizes, sizes
                flat.append(ids)
        flat = np.concatenate(flat)
        kept = np.nonzero(often & ~old)[0]
        self._keep([words[k] for k in kept], _gather(flat, at, length, kept), length[kept])
        return np.nonzero(start)[0], _gather(flat, at, length, number), length[number]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has. A long text is cut at blanks inside."""
        data, ends = _data(texts)
        out, sizes = [], np.zeros(len(ends) - 1, np.int64)
        a = 0
        while a < len(data):
            if len(self.index) > MAX_KEPT or self.chars > MAX_CHARS:
                self.clear()
            z = a + LOT
            if z < len(data):  # back to a blank or a text's end, or on to the next one
                back = np.nonzero(KIND[data[a:z]] == BLANK)[0]
                text_end = ends[np.searchsorted(ends, z, "right") - 1]
                z = max(int(a + back[-1] + 1) if len(back) else 0, int(text_end))
                if z <= a:
                    on = np.nonzero(KIND[data[a:]] == BLANK)[0]
                    z = min(int(a + on[0] + 1) if len(on) else len(data), int(ends[np.searchsorted(ends, a, "right")]))
            z = min(z, len(data))
            inside = ends[(ends >= a) & (ends < z)]
            place, ids, own = self._lot(data[a:z], inside - a)
            out.append(ids)
            upto = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(place, ends - a)]
            sizes += np.diff(upto)
            a = z
        return np.concatenate(out) if out else np.zeros(0, np.uint32), sizes


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
    """The rows flat[start[k] : start[k] + length[k]], of these numbers or of all, joined."""
    if number is None:
        number = np.arange(len(start))
    upto = np.cumsum(length[number])
    out = np.empty(int(upto[-1]) if len(upto) else 0, flat.dtype)
    a = at = 0
    while a < len(number):
        z = max(a + 1, int(np.searchsorted(upto, at + GATHER, "right")))
        sizes = length[number[a:z]]
        n = int(sizes.sum())
        out[at : at + n] = flat[np.repeat(start[number[a:z]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)]
        a, at = z, at + n
    return out


def _data(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, joined, and where each begins, with the end; nulls are empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder: kept from task to task."""
    return worker_cache(f"wordpiece {path}", lambda: ChunkEncoder(path))


def slices(texts: pa.Array, most: int = LOT):
    """Ranges of rows with about so many bytes at most (one row at least), to bound memory."""
    ends = _data(texts)[1]
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, z
        a = z
