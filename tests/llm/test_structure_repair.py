"""Structure repair against trying all edits, and edge cases."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from tributary.llm import structure_repair as own

SOUND = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "none" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired turns) by trying all edits, cheapest first, with few insertions anywhere."""
    bad = faults(rows)
    best = None

    def go(k, cost, audit, turns, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            if SOUND.fullmatch("".join(r[:1] for r, _ in turns)) and (not best or (cost, audit) < best[:2]) and all(r for r, _ in turns):
                best = (cost, audit, turns)
        else:
            role, text = rows[k]
            go(k + 1, cost + 2, audit + "D", turns, inserts)
            if bad[k] not in ("blank", "duplicate"):
                stays = 5 if bad[k] == "truncated" else 0
                go(k + 1, cost + stays, audit + "K", [*turns, (role, text)], inserts)
                for new in ("user", "assistant"):
                    go(k + 1, cost + 1 + stays, audit + "R", [*turns, (new, text)], inserts)
        if inserts:
            for new in ("user", "assistant"):
                go(k, cost + 5, audit + "I", [*turns, (new, "")], inserts - 1)

    best = (2 * len(rows) + 1, "", [])
    go(0, 0, "", [], 2)
    return best


def expected(turns):
    """The contract's columns of each conversation of (conv_id, turn, role, text) rows, by plain Python."""
    out = {}
    for conv in {c for c, *_ in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        said = [x[1:] for x in rows]
        bad, numbers = faults(said), [t for t, *_ in rows if t is not None]
        cost, audit, repaired = cheapest(said)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, digest)
    return out


def made(r, convs):
    rows = []
    for conv in range(convs):
        for turn in range(r.randint(0, 7)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "University"])
            text = r.choice(["Hi.", "What?", "cut", "No!  ", "", " \t", None, "Fine.", "a\x1c", "Well...", "end.\x0b"])
            rows.append((conv, r.choice([turn, turn, turn + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("chart", [256, 2])
def test_repairs_equal_trying_all_edits(spark, monkeypatch, chart):
    monkeypatch.setattr(own, "CHART", chart)
    rows = made(random.Random(chart), 60)
    rows += rows[:20] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (None, 2, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' audit", "1 n", "2 place").repartition(5)
    monkeypatch.setattr(own, "table", lambda *_: df)
    got = {x.conv_id: tuple(x)[1:] for x in own.op12_structure_repair(spark, "").collect()}
    assert got == expected(rows)


def test_segments_join_as_one_chart():
    r = random.Random(3)
    symbols = [r.choice("suax") + r.choice("--td") for _ in range(40)]
    whole = own.charts(tuple(symbols))
    for cuts in ([7], [1, 2, 30], list(range(1, 40))):
        parts = [own.charts(tuple(symbols[a:b])) for a, b in zip([0, *cuts], [*cuts, 40])]
        assert own.all_joined(parts) == whole


def test_a_long_conversation_lies_in_many_segments(spark, monkeypatch):
    """One conversation of 3,000 turns beside short ones, and 500 equal turns: as parsed in one piece."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(3000)] + [(1, 5000, "user", "again.")] * 500
    rows += [(c, t, ["user", "assistant"][t % 2], "x.") for c in range(2, 40) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    placed = own._numbered(own.damage(df)).cache()
    assert placed.where("conv_id = 1").select("segment").distinct().count() > 1
    monkeypatch.setattr(own, "table", lambda *_: df)
    got = own.op12_structure_repair(spark, "").where("conv_id = 1").first()
    turns = [(x.role, x.fault, x.n) for x in placed.where("conv_id = 1").orderBy("turn", "role", "text").collect()]
    mark = {"blank": "d", "duplicate": "d", "truncated": "t", "none": "-"}
    symbols = [s for role, fault, n in turns for s in [role[0] + mark[fault], *["xd"] * (n - 1)]]
    column = own.charts(tuple(symbols))[own.NOTHING]
    assert (got.cost, got.audit) == min(column[x] for x in own.SOUND if x in column)
    assert got.gaps == 2000 + sum(zlib.crc32(f"1:{t}".encode()) % 20 == 0 for t in range(3000))
    assert got.duplicate >= 499


def test_repaired_turns_are_sound(spark):
    rows = made(random.Random(9), 80)
    out = own.repair(own.damage(spark.createDataFrame(rows, SCHEMA)))
    turns = sorted(out.collect(), key=lambda x: (x.conv_id, x.turn))
    for _, group in groupby(turns, key=lambda x: x.conv_id):
        group = list(group)
        assert SOUND.fullmatch("".join(x.role[0] for x in group)) and [x.turn for x in group] == list(range(len(group)))


def test_nothing_and_a_conversation_that_loses_all_turns(spark, monkeypatch):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    for rows in ([], [(gone, 0, "user", "Hi.")]):
        df = spark.createDataFrame(rows, SCHEMA)
        monkeypatch.setattr(own, "table", lambda *_, df=df: df)
        got = [tuple(x) for x in own.op12_structure_repair(spark, "").collect()]
        assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows]


def test_long_texts_and_extreme_turns(spark, monkeypatch):
    rows = [(1, -(2**63), "user", "long " * 300_000 + "."), (1, 2**63 - 1, "assistant", " " * 500_000), (2, 3, "user", "." + " " * 400_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(own, "table", lambda *_: df)
    got = {x.conv_id: x for x in own.op12_structure_repair(spark, "").collect()}
    assert set(got) == {1, 2} and (got[1].gaps is None or got[1].gaps == 0)
