"""Repair of conversations' structure by error-correcting Earley parsing.

A sound conversation has an optional system turn and then pairs of user and assistant turns. The grammar says so with four
nonterminals, by what a repaired beginning ends in: nothing yet, a system, a user or an assistant turn. Besides keeping a
turn its productions may rerole, delete or insert one, each at a cost. A chart item keeps the least (cost, audit) of its
derivations, the audit being the edits' letters in order, and the least completed chart yields the repair. Productions are
left-recursive, so all items begin where the chart begins and a chart grows in proportion to the turns.

A conversation may be long. Its turns are range-sorted, so it lies in as many segments as partitions; each segment's charts
are parsed for every nonterminal that may stand before it, and charts of neighbours are joined, which is associative. Equal
turns of one number are one row with a count, as all but one of them can only be deleted.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table, worker_cache

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, by letter, and of a truncated turn that stays.
COST, TRUNCATED = {"K": 0, "R": 1, "D": 2, "I": 5}, 5
#: head -> nonterminal, what is read next: a kept turn of some role, or any turn by a letter.
PRODUCTIONS = [
    (SYSTEM, NOTHING, "s"),
    *((USER, before, read) for before in (NOTHING, SYSTEM, ASSISTANT) for read in ("u", "R", "I")),
    *((ASSISTANT, USER, read) for read in ("a", "R", "I")),
    *((x, x, "D") for x in (NOTHING, SYSTEM, USER, ASSISTANT)),
]
#: Nonterminals in which a whole log may end.
SOUND = (NOTHING, ASSISTANT)
#: Turns of one chart; longer segments join several.
CHART = 256
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


def _close(column: dict) -> dict:
    """Completes a chart column: insertions read no turn, so they are tried until no item gets better."""
    agenda = list(column)
    while agenda:
        done = agenda.pop()
        cost, audit = column[done]
        for head, before, read in PRODUCTIONS:
            if before == done and read == "I":
                item = (cost + COST["I"], audit + "I")
                if head not in column or item < column[head]:
                    column[head] = item
                    agenda.append(head)
    return column


def _scan(column: dict, symbol: str) -> dict:
    """The next column: each item is advanced over a turn, read as one of its initial kept or by an edit's letter.

    symbol: the role's initial (s, u, a, or x for any other) and its fault: "-" none, "t" truncated, "d" to be deleted.
    """
    out: dict = {}
    stays = TRUNCATED if symbol[1] == "t" else 0
    for head, before, read in PRODUCTIONS:
        if before not in column or read == "I" or (symbol[1] == "d" and read != "D"):
            continue
        if read in "sua":
            if read != symbol[0]:
                continue
            letter, more = "K", stays
        else:
            letter, more = read, stays if read == "R" else 0
        cost, audit = column[before]
        item = (cost + COST[letter] + more, audit + letter)
        if head not in out or item < out[head]:
            out[head] = item
    return _close(out)


@lru_cache(maxsize=1 << 14)
def charts(symbols: tuple[str, ...]) -> tuple:
    """For each nonterminal before, a column: nonterminal after the symbols -> least (cost, audit)."""
    return tuple(reduce(_scan, symbols, _close({before: (0, "")})) for before in range(4))


def joined(left: tuple, right: tuple) -> tuple:
    """Charts of two runs of turns, one after the other."""
    out = []
    for column in left:
        met: dict = {}
        for via, (cost, audit) in column.items():
            for after, (more, rest) in right[via].items():
                item = (cost + more, audit + rest)
                if after not in met or item < met[after]:
                    met[after] = item
        out.append(met)
    return tuple(out)


def all_joined(parts: list[tuple]) -> tuple:
    """Charts of many runs, joined in pairs."""
    while len(parts) > 1:
        parts = [joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (how often the row stands there) of what is left after damage by crc32 of conv_id:turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def _numbered(rows: DataFrame) -> DataFrame:
    """One row for equal ones, with n, the first one's fault, and its place: a segment and a position in it.

    Rows are ordered by turn (nulls first), role and text. fault: blank, duplicate, truncated or none.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"))
    again = again.agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("times")).where("times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    met = once.join(again, same, "left").withColumn("end", F.right(end, F.lit(1)))
    later = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    fault = F.when(F.col("end") == "", "blank").when(later, "duplicate").when(~F.col("end").isin(*".!?"), "truncated").otherwise("none")
    order = ["conv_id", "turn", "role", "text"]
    placed = met.select(*order, "n", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumns({"segment": F.spark_partition_id(), "place": F.monotonically_increasing_id()})


def _runs(batches, keys: int):
    """(key, rows) of consecutive rows with equal first columns; the rows are an iterator to be used up first."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda row: row[:keys])


def _parse(placed: DataFrame) -> DataFrame:
    """conv_id, segment, its first and last initial, illegal neighbours in it and its charts, flat."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("-")
    rows = placed.select("conv_id", "segment", "place", F.concat(initial, mark).alias("symbol"), "n")
    # a number of its own: such rows are small, and a task of a planner's usual size would parse very many
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches):
        worker_cache("structure-repair", dict)  # nothing is kept here; other operators' caches go
        for (conv, segment), turns in _runs(batches, 2):
            parts, symbols, illegal, first, last = [], [], 0, None, None
            for _, _, _, symbol, n in turns:
                illegal += n - 1 + (last is not None and last + symbol[0] not in LEGAL)
                first, last = first or symbol[0], symbol[0]
                symbols.append(symbol)
                while n > 1:  # what else is equal to it goes
                    more = min(n - 1, CHART)
                    symbols += ["xd"] * more
                    n -= more
                while len(symbols) >= CHART:
                    parts.append(charts(tuple(symbols[:CHART])))
                    symbols = symbols[CHART:]
                if len(parts) > CHART:
                    parts = [all_joined(parts)]
            whole = all_joined([*parts, charts(tuple(symbols))])
            flat = [{"before": b, "after": a, "cost": c, "audit": x} for b, column in enumerate(whole) for a, (c, x) in column.items()]
            key = pa.array([conv], convs)
            rest = [pa.array([segment], pa.int32()), pa.array([first]), pa.array([last]), pa.array([illegal], pa.int64()), pa.array([flat], kind)]
            yield pa.RecordBatch.from_arrays([key, *rest], ["conv_id", "segment", "first", "last", "illegal", "charts"])

    convs = to_arrow_type(rows.schema["conv_id"].dataType)
    ddl = "segment int, first string, last string, illegal bigint, charts array<struct<before:int,after:int,cost:bigint,audit:string>>"
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {ddl}")


def _decide(parsed: DataFrame) -> DataFrame:
    """conv_id, segment and edits, the segment's part of the cheapest audit, with the whole cost and illegal neighbours."""
    rows = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    convs = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        worker_cache("structure-repair", dict)
        for (conv,), segments in _runs(batches, 1):
            best, last, illegal, numbers = {NOTHING: (0, "", ())}, None, 0, []
            for _, segment, first, end, wrong, flat in segments:
                illegal += wrong + (last is not None and last + first not in LEGAL)
                last = end
                numbers.append(segment)
                met: dict = {}
                for x in flat:
                    if x["before"] in best:
                        cost, audit, cuts = best[x["before"]]
                        item = (cost + x["cost"], audit + x["audit"], (*cuts, len(x["audit"])))
                        if x["after"] not in met or item[:2] < met[x["after"]][:2]:
                            met[x["after"]] = item
                best = met
            cost, audit, cuts = min((best[x] for x in SOUND if x in best), key=lambda item: item[:2])
            at, pieces = 0, []
            for n in cuts:
                pieces.append(audit[at : at + n])
                at += n
            k = len(pieces)
            columns = [pa.array([conv] * k, convs), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())]
            columns += [pa.array([cost] * k, pa.int64()), pa.array([illegal] * k, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "edits", "cost", "illegal"])

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, segment int, edits string, cost bigint, illegal bigint")


class _Writer:
    """Applies edits to turns as they come; gives (role, text) of what stays."""

    def __init__(self):
        self.edits, self.at, self.last = "", 0, NOTHING

    def next_edits(self, edits: str):
        yield from self.inserted()
        self.edits, self.at = edits, 0

    def _filled(self) -> str:
        self.last = ASSISTANT if self.last == USER else USER
        return "assistant" if self.last == ASSISTANT else "user"

    def inserted(self):
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._filled(), ""

    def turn(self, role: str, text: str, n: int):
        for _ in range(n):
            yield from self.inserted()
            letter = self.edits[self.at]
            self.at += 1
            if letter == "R":
                yield self._filled(), text
            elif letter == "K":
                self.last = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield role, text


def _in_order(placed: DataFrame, decided: DataFrame) -> DataFrame:
    """Turns and each segment's edits before them, a conversation in one task, in order."""
    turns = placed.select("conv_id", "segment", "place", "role", "text", "n", F.lit(None).cast("bigint").alias("cost"), F.lit(None).cast("bigint").alias("illegal"))
    heads = decided.select("conv_id", "segment", F.lit(-1).cast("bigint"), F.lit(None).cast("string"), "edits", F.lit(0).cast("bigint"), "cost", "illegal")
    return turns.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place")


def _lines(rows):
    """(role, text) of a conversation's repaired turns, from rows of _in_order."""
    writer = _Writer()
    for _, _, place, role, text, n, _, _ in rows:
        yield from writer.next_edits(text) if place < 0 else writer.turn(role, text, n)
    yield from writer.inserted()


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role and text of the repaired conversations, from conv_id, turn, role, text and n.

    Rows are parsed as they are (n: how often a row stands there), ordered by turn (nulls first), role and text. Rows of a
    null conv_id are one conversation. One with no turns left gives no rows.
    """
    placed = stored(_numbered(turns), "repair-turns")
    rows = _in_order(placed, stored(_decide(_parse(placed)), "repair-edits"))
    convs, names = to_arrow_type(rows.schema["conv_id"].dataType), ["conv_id", "turn", "role", "text"]

    def run(batches):
        for (conv,), given in _runs(batches, 1):
            for k, (role, text) in enumerate(_lines(given)):
                yield pa.RecordBatch.from_arrays([pa.array([conv], convs), pa.array([k], pa.int64()), pa.array([role]), pa.array([text])], names)

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn bigint, role string, text string")


def audited(turns: DataFrame) -> DataFrame:
    """One row for each conversation that has turns: its gaps, faults, cost, audit and the repaired turns' sha256.

    turns: conv_id, turn, role, text (no nulls in the last two) and n, as damage() gives them; repair() says how they are
    ordered. Hashing reads a conversation's turns one after the other, so that is done in one task, with one turn held at a
    time; all before it is split by segments. gaps is null where it does not fit a long. A null conv_id is a conversation
    like any other; a role that is empty or begins with none of s, u and a cannot be kept; of repairs of one cost the
    ASCII-least audit counts. Equal rows are repeats; other columns are not read; an empty table gives no rows.
    """
    placed = stored(_numbered(turns), "repair-turns")
    decided = stored(_decide(_parse(placed)), "repair-edits")
    rows = _in_order(placed, decided)
    convs = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        worker_cache("structure-repair", dict)
        for (conv,), given in _runs(batches, 1):
            pieces, known = [], []

            def heard(given=given, pieces=pieces, known=known):
                for row in given:
                    if row[2] < 0:
                        pieces.append(row[4])
                        known[:] = row[6:]
                    yield row

            digest, between = hashlib.sha256(), b""
            for role, text in _lines(heard()):
                digest.update(between + f"{role}:".encode("utf-8", "surrogatepass"))
                digest.update(text.encode("utf-8", "surrogatepass"))
                between = b"\n"
            columns = [pa.array([conv], convs), pa.array(known[:1], pa.int64()), pa.array(known[1:], pa.int64()), pa.array(["".join(pieces)]), pa.array([digest.hexdigest()])]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "cost", "illegal", "audit", "repaired_sha256"])

    conv = rows.schema["conv_id"].dataType.simpleString()
    told = rows.mapInArrow(run, f"conv_id {conv}, cost bigint, illegal bigint, audit string, repaired_sha256 string")
    of = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).cast("bigint")
    # all but one of equal rows are blank if it is, and duplicates else
    blank = F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).cast("bigint")
    copies = F.sum(F.when(F.col("fault") != "blank", F.col("n") - 1).otherwise(0)).cast("bigint")
    wide = lambda x: x.cast("decimal(20,0)")
    span = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.countDistinct("turn"))
    faults = placed.groupBy(F.col("conv_id").alias("c")).agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), blank.alias("blank"), (of("duplicate") + copies).alias("duplicate"), of("truncated").alias("truncated")
    )
    both = told.join(faults.withColumn("gaps", F.expr("try_cast(gaps as bigint)")), F.col("conv_id").eqNullSafe(F.col("c")))
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Every conv_id of conversations, its turns damaged, then audited; one whose turns are all gone has zeros."""
    turns = table(spark, sf_dir, "conversations")
    found = audited(damage(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = {c: F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    rest = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return every.withColumns(numbers | rest)
