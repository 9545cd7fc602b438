"""Licence scans against a plain matcher of each template at each word, and edge cases."""

import random
import re

import pytest

from tributary.llm import license_scan
from tributary.llm.license_scan import Automaton, scan
from tributary.llm.license_templates import BASE, TEMPLATES

DOCS = "doc_id long, text string"


def pattern(markup):
    """A template as a regular expression over words, each followed by a space."""
    out, upto = "", 0
    for tag in [*license_scan.TAG.finditer(markup), None]:
        out += "".join(re.escape(w.decode()) + " " for w in license_scan.words(markup[upto : tag.start() if tag else None]))
        if tag is None:
            return re.compile(out)
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(tag[1]) or "(?:[^ ]+ ){%s,%s}" % (tag[2], tag[3])
        upto = tag.end()


def plain(templates, ws):
    """(start, template, farthest end) by trying every end."""
    return [
        (i, k, max(ends))
        for i in range(len(ws))
        for k, (_, markup) in enumerate(templates)
        if (ends := [j for j in range(i + 1, len(ws) + 1) if pattern(markup).fullmatch("".join(w.decode() + " " for w in ws[i:j]))])
    ]


TOY = [
    ("a", "x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> x"),
    ("b", "x <<var;words=0-3>> y"),
    ("c", "y <<var;words=1-2>> <<beginOptional>>x<<endOptional>> z <<beginOptional>>z x<<endOptional>>"),
    ("a", "z z"),
]


@pytest.mark.parametrize("most", [50_000, 2])
def test_matches_equal_a_plain_matcher(monkeypatch, most):
    monkeypatch.setattr(license_scan, "MOST_STATES", most)
    r = random.Random(5)
    automaton = Automaton(TOY)
    for _ in range(150):
        ws = [r.choice([b"x", b"y", b"z", b"o"]) for _ in range(r.randint(0, 14))]
        assert automaton.matches(ws) == plain(TOY, ws)


def filled(markup, r):
    """Wording that a template accepts, with regions left out or filled at random."""
    out, keep, upto = [], [True], 0
    for tag in [*license_scan.TAG.finditer(markup), None]:
        if keep[-1]:
            out.append(markup[upto : tag.start() if tag else None])
        if tag is None:
            return " ".join(out)
        upto = tag.end()
        if tag[1] == "beginOptional":
            keep.append(keep[-1] and r.random() < 0.5)
        elif tag[1] == "endOptional":
            keep.pop()
        elif keep[-1]:
            out.append("w " * r.randint(int(tag[2]), int(tag[3])))


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_templates_accept_their_wording_and_nothing_else(k):
    r = random.Random(k)
    label, markup = TEMPLATES[k]
    automaton = Automaton([TEMPLATES[k]])
    for _ in range(5):
        text = filled(markup, r)
        ws = license_scan.words("Before. " + text.upper() + " after")
        found = [m for m in automaton.matches(ws) if m[0] == 1]
        assert found and found[0][2] >= len(ws) - 1
    wanted = [w for w in license_scan.words(license_scan.TAG.sub(" ", re.sub(r"<<beginOptional>>[^<]*", " ", markup))) if w != b"w"]
    broken = [b"other" if w == wanted[len(wanted) // 2] else w for w in license_scan.words(filled(markup, r))]
    assert all(pattern(markup).match("".join(w.decode() + " " for w in broken[i:])) for i, _, _ in automaton.matches(broken))


def test_a_template_begins_with_wording():
    for markup in ("", "<<var;words=0-2>> x", "<<beginOptional>>x<<endOptional>>", "<<beginOptional>> x"):
        with pytest.raises(ValueError):
            Automaton([("a", markup)])


def plain_base(ws):
    phrases = [(label, license_scan.words(p)) for label, p in BASE]
    return [(i, label) for i in range(len(ws)) for label, p in phrases if ws[i : i + len(p)] == p]


TEXTS = [
    None, "", " \n", "MIT License", "mit\n*license* MIT-LICENSE, mit licence", "Released under the Apache License, Version 2.0.",
    "GNU General Public License, version 3 general public license", "İ MIT licenseé mit license", "Licensed under CC BY-NC 4.0.",
    "the " * 300_000 + "mit license", "mit " * 200_000, "MIT License", "a\x1cmit\x00license",
]


def test_digest_columns(spark, monkeypatch):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "mit license"), (3, "MIT License")], DOCS).selectExpr("*", "1 n_words", "2 matches").repartition(3)
    monkeypatch.setattr(license_scan, "table", lambda *_: df)
    got = license_scan.op11_license_scan(spark, "").collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        ws = license_scan.words("mit license" if row.doc_id is None else TEXTS[row.doc_id])
        at = plain_base(ws)
        assert (row.n_words, row.n_base) == (len(ws), len(at))
        assert (row.first_word, row.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[8].labels, by[8].n_base, by[8].template_spans, by[8].score) == ("cc-by-nc", 0, "cc-by-nc:0:7,cc-by-nc:2:7", 1.0)
    assert by[5].labels == "apache,apache-2.0" and by[6].labels == "gpl,gpl-3.0" and by[4].n_base == 2


def test_an_empty_table(spark):
    assert scan(spark.createDataFrame([], DOCS)).count() == 0
