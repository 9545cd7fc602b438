"""Best-fit packing by linear grouping.

Large lengths are rounded up within groups of equal cardinality, which leaves few sizes; column generation finds
configurations of those sizes; the actual documents, longest first, take the places of their group; small documents
are then best-fitted into what is left. Everything that decides is a histogram of lengths (at most ``capacity``
numbers) and runs of like sequences, so the driver's work does not grow with the corpus. A piece finds its place from
its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .wordpiece import default_path, encoder, slices

#: Lengths above a third of the capacity are large.
CAPACITY, GROUPS, SMALL = 2048, 256, 3
#: Shares of the configurations' uses that are tried; what they leave is best-fitted, all of it at 0.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.5, 0.25, 0.0)


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used, towards an optimum of the relaxed cutting problem.

    Columns come in until none improves, or one has come in for each size. That bounds the effort and not what is
    packed: pieces that the configurations do not take are best-fitted.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(k):
        y = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fit = np.nonzero(sizes <= c)[0]
            worth = y[fit] + best[c - sizes[fit]]
            top = int(np.argmax(worth))
            if worth[top] > best[c - 1] + 1e-12:
                best[c], pick[c] = worth[top], fit[top]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        move = np.linalg.solve(basis, column)
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(0.0, ratio[out])
        x = x - step * move
        x[out] = step
        basis[:, out] = column
    return basis, np.maximum(x, 0)


class Plan:
    """Runs by length: pieces of a length numbered from ``first`` lie in sequences from ``sequence`` on, at ``offset``.

    ``count`` maps lengths to numbers of pieces; each configuration is used as often as the relaxed problem says, times
    ``share``. ``found`` keeps configurations for plans of the same count.
    """

    def __init__(self, count: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, share: float = 1.0, found: dict | None = None):
        self.capacity, self.share, self.found = capacity, share, {} if found is None else found
        self.left = {n: c for n, c in sorted(count.items(), reverse=True) if c}
        self.given = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.sequences = 0
        self.open: dict[int, deque] = defaultdict(deque)  # room -> runs (first sequence, how many)
        self.rooms: list[int] = []
        full = self.left.pop(capacity, 0)
        if full:
            self._put(capacity, self._new(full), full, 0)
        self._grouped(groups)
        for n in list(self.left):
            self._best_fit(n)

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, sequence: int, n: int, offset: int) -> None:
        self.runs[length].append((self.given[length], sequence, offset))
        self.given[length] += n

    def _room(self, room: int, sequence: int, n: int) -> None:
        if room <= 0:
            return
        if not self.open[room]:
            insort(self.rooms, room)
        self.open[room].append((sequence, n))

    def _grouped(self, groups: int) -> None:
        large = [(n, c) for n, c in self.left.items() if n * SMALL > self.capacity]
        total = sum(c for _, c in large)
        if not total:
            return
        each = -(-total // groups)  # fewer pieces than groups are a group each
        members: list[list[list[int]]] = []  # by group: [length, pieces], longest first
        room = 0
        for n, c in large:
            while c:
                if not room:
                    members.append([])
                    room = each
                take = min(c, room)
                members[-1].append([n, take])
                c, room = c - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged))
        demand = np.array([sum(c for _, c in m) for m in merged.values()], float)
        if not self.found:
            self.found["patterns"] = _patterns(sizes, demand, self.capacity)
        basis, x = self.found["patterns"]
        queues = [deque(map(list, m)) for m in merged.values()]
        spare = demand.astype(np.int64)
        for j in np.argsort(-x):
            column = np.rint(basis[:, j]).astype(int)
            n = int(np.floor(self.share * x[j] + 1e-6))
            used = np.nonzero(column)[0]
            if len(used):
                n = min(n, int(min(spare[i] // column[i] for i in used)))
            if n <= 0 or not len(used):
                continue
            first = self._new(n)
            fill = [(first, n, 0)]  # runs of these sequences by what they hold
            for i in used:
                for _ in range(column[i]):
                    fill = self._slot(queues[i], fill)
                spare[i] -= n * column[i]
            for sequence, many, held in fill:
                self._room(self.capacity - held, sequence, many)

    def _slot(self, queue: deque, fill: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Puts one more piece of a group, longest first, into each sequence of the runs."""
        out = []
        for sequence, many, held in fill:
            while many:
                length, there = queue[0]
                n = min(many, there)
                self._put(length, sequence, n, held)
                self.left[length] -= n
                out.append((sequence, n, held + length))
                sequence, many = sequence + n, many - n
                if n == there:
                    queue.popleft()
                else:
                    queue[0][1] -= n
        return out

    def _best_fit(self, length: int) -> None:
        left = self.left[length]
        while left:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                n, per = (left // per, per) if left >= per else (1, left)
                first = self._new(n)
                for p in range(per):
                    self._put(length, first, n, p * length)
                self._room(self.capacity - per * length, first, n)
                left -= n * per
                continue
            room = self.rooms[k]
            sequence, many = self.open[room].popleft()
            n = min(many, left)
            if n < many:
                self.open[room].appendleft((sequence + n, many - n))
            if not self.open[room]:
                del self.rooms[k]
            self._put(length, sequence, n, self.capacity - room)
            self._room(room - length, sequence, n)
            left -= n
        self.left[length] = 0

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {n: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for n, runs in self.runs.items()}


def best_plan(count: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan with the fewest sequences among SHARES of the configurations, the largest share among equals.

    Rounding lengths up leaves sequences with a few tokens of room that nothing fits; the fewer configurations are used,
    the more small pieces meet exact rooms. No plan has more sequences than best-fit alone, which is the last one tried;
    where the tokens fill all sequences but one, none can have fewer and the search ends.
    """
    least = -(-sum(n * c for n, c in count.items()) // capacity)
    found: dict = {}
    best = None
    for share in SHARES:
        plan = Plan(count, capacity, groups, share, found)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def pieces_of(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids of every whole text, with the writing task and the number among its pieces of
    that length. A null text has the end id alone."""
    tokenizer = tokenizer or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1)
            for a, z in slices(texts):
                ids, sizes = encoder(tokenizer).encode(texts.slice(a, z - a))
                held, at = [], 0
                for doc, size in zip(doc_ids.slice(a, z - a).to_pylist(), sizes.tolist(), strict=True):
                    own = np.append(ids[at : at + size], np.uint32(end_id)).astype("<u4")
                    at += size
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row = (doc, k, s, len(part), zlib.crc32(part), task, int(seen[len(part)]))
                        held.append((*row, part.astype(np.int32)) if with_ids else row)
                        seen[len(part)] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Packs all docs (doc_id, text): a row for each piece with its sequence and its gapless place there.

    The pieces are written once; their numbers by length come from counts by task and length, a window of as many rows
    for a length as there are tasks. The plan's runs are broadcast: their number depends on capacity and groups.
    A null or empty text has the end id alone; rows that repeat or have no doc_id are packed each; other columns are not
    read; an empty table packs to no rows. Pieces of one length take places in the order of their numbers. A very long
    text is encoded in lots and cut into pieces of the capacity.
    """
    spark = docs.sparkSession
    made = stored(pieces_of(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("task"))
    base = by_task.select("length", "task", (upto - F.col("n")).alias("before"))
    count = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_plan(count, capacity, groups).arrays())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("nth").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.nonzero(np.diff(length[order]))[0] + 1
            for own in np.split(order, cuts) if len(order) else []:
                first, to, at = plan.value[int(length[own[0]])]
                run = np.searchsorted(first, number[own], "right") - 1
                sequence[own], offset[own] = to[run] + number[own] - first[run], at[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            cols = [b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            if with_ids:
                cols.append(b.column("ids"))
            yield pa.RecordBatch.from_arrays(cols, names + ["sequence_id", "offset"] + ["ids"] * with_ids)

    return made.join(base, ["length", "task"]).mapInArrow(place, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
