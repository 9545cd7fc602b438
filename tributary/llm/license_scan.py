"""Licence scans by template-markup matching.

Templates hold mandatory wording, optional regions and replaceable regions (``license_templates``). All of them, and the
base phrases, which are templates without regions, are compiled into one automaton over words; it is determinised as
texts meet it. A template matches where its automaton, started at a word, is led by the words that follow to an accepting
state: then all mandatory wording stands there exactly, in order. Of the places where it could end the farthest counts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, worker_cache
from .license_templates import BASE, TEMPLATES

#: Lower-cases A-Z and makes every other ASCII character that is no letter or digit a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TAG = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
#: Determinised states kept; beyond them they are made anew.
MOST_STATES = 50_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """One automaton of many templates (label, markup); base says of how many the phrases come first."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.after: list[list[int]] = []  # states reached without a word
        self.step: list[tuple[bytes | None, int] | None] = []  # a word (None: any) and the state it leads to
        self.ends: dict[int, int] = {}
        starts = []
        for k, (_, markup) in enumerate(templates):
            start = self._state()
            starts.append(start)
            self.ends[self._compile(markup, start)] = k
        self.alphabet = {s[0] for s in self.step if s and s[0] is not None}
        self.start = self._closed(starts)
        if self._accepts(self.start) or None in {self.step[q][0] for q in self.start if self.step[q]}:
            raise ValueError("a template that does not begin with wording")
        self.first = {self.step[q][0] for q in self.start if self.step[q]}
        self._forget()

    def _state(self) -> int:
        self.after.append([])
        self.step.append(None)
        return len(self.after) - 1

    def _word(self, state: int, word: bytes | None) -> int:
        to = self._state()
        self.step[state] = (word, to)
        on = self._state()
        self.after[to].append(on)
        return on

    def _compile(self, markup: str, at: int) -> int:
        opened, upto = [], 0
        for tag in [*TAG.finditer(markup), None]:
            for w in words(markup[upto : tag.start() if tag else len(markup)]):
                at = self._word(at, w)
            if tag is None:
                break
            upto = tag.end()
            if tag[1] == "beginOptional":
                opened.append(at)
                inner = self._state()
                self.after[at].append(inner)
                at = inner
            elif tag[1] == "endOptional":
                done = self._state()
                self.after[at].append(done)
                self.after[opened.pop()].append(done)
                at = done
            else:
                least, most = int(tag[2]), int(tag[3])
                done = self._state()
                for k in range(most):
                    if k >= least:
                        self.after[at].append(done)
                    at = self._word(at, None)
                self.after[at].append(done)
                at = done
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for q in self.after[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(q for q in seen if self.step[q] or q in self.ends)

    def _accepts(self, states) -> list[int]:
        return sorted(self.ends[q] for q in states if q in self.ends)

    def _forget(self) -> None:
        self.names = {self.start: 0}
        self.sets, self.moves, self.accepts = [self.start], [{}], [self._accepts(self.start)]

    def _move(self, state: int, word: bytes | None) -> int:
        """The state that a word (None: one that no template holds) leads to, or -1; made when first met."""
        to = self._closed([s[1] for s in map(self.step.__getitem__, self.sets[state]) if s and s[0] in (None, word)])
        if not to:
            self.moves[state][word] = -1
            return -1
        if to not in self.names:
            self.names[to] = len(self.sets)
            self.sets.append(to)
            self.moves.append({})
            self.accepts.append(self._accepts(to))
        self.moves[state][word] = self.names[to]
        return self.names[to]

    def matches(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, template, end) by start and template; for each start and template the farthest end."""
        out, alphabet, first = [], self.alphabet, self.first
        for i in [i for i, w in enumerate(ws) if w in first]:
            if len(self.sets) > MOST_STATES:
                self._forget()
            state, j, found = 0, i, {}
            moves, accepts = self.moves, self.accepts
            while j < len(ws):
                w = ws[j] if ws[j] in alphabet else None
                to = moves[state].get(w)
                state = self._move(state, w) if to is None else to
                if state < 0:
                    break
                j += 1
                for k in accepts[state]:
                    found[k] = j
            out += [(i, k, found[k]) for k in sorted(found)]
        return out


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places spans (start, end), in order of their start, cover together."""
    total = upto = 0
    for a, b in spans:
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_covered (words in any match) and matches (label, base, first, end: words from 0) of each document.

    A narrow map: one row for each row of docs, whatever its doc_id (null and repeated ones too); other columns are not
    read. A null or empty text has no words and no matches; texts are read whole, and of the automaton's states a bounded
    number is kept. Equal matches of one label at one start count once, with the farthest end. An empty table gives none.
    """
    rows = docs.select("doc_id", "text")
    templates_all, n_base = [*base, *templates], len(base)

    def run(batches):
        worker_cache("license-scan", dict)  # nothing is kept here; other operators' caches go
        automaton = Automaton(templates_all)
        labels = [x for x, _ in templates_all]
        for b in batches:
            n, n_covered, found = [], [], []
            for text in b.column(1).to_pylist():
                ws = words(text)
                at = automaton.matches(ws)
                longest: dict = {}
                for i, k, j in at:
                    key = (i, labels[k], k < n_base)
                    longest[key] = max(j, longest.get(key, 0))
                n.append(len(ws))
                n_covered.append(covered([(i, j) for i, _, j in at]))
                found.append([{"label": x, "base": is_base, "first": i, "end": j} for (i, x, is_base), j in longest.items()])
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(n_covered, pa.int64())]
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, kind)], ["doc_id", "n_words", "n_covered", "matches"])

    match = "array<struct<label:string,base:boolean,first:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_covered bigint, matches {match}")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    own = F.filter("matches", lambda m: ~m["base"])
    spans = F.transform(own, lambda m: F.concat_ws(":", m["label"], m["first"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
        F.array_join(spans, ",").alias("template_spans"),
    )
