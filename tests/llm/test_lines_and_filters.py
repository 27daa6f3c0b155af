"""Line removal and the filter audit against plain Python and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from shortlist.llm import filter_audit, line_dedup
from shortlist.llm.queries import ORACLES, QUERIES
from tests.llm.frames import ODD_TEXTS, documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"
EXTRA = "_lines string, _keep string, n_lines string, _slice int, _h1 long, keep long"


@pytest.mark.parametrize("name", ["op12_drop_lines", "op13_audit_filters"])
def test_query_equals_its_sql(spark, name):
    same, note = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert same, note


# --- lines ------------------------------------------------------------------------------


def _key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def _plain_lines(rows, least=10):
    """Per row: key, lines, dropped positions."""
    owner, holders = {}, {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            if key is not None and len(_key(line)) >= least:
                owner[_key(line)] = min(key, owner.get(_key(line), key))
                holders.setdefault(_key(line), set()).add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        gone = [i for i, x in enumerate(lines)
                if key is not None and len(_key(x)) >= least and owner[_key(x)] < key]
        out.append((key, lines, gone))
    return out


def _check_lines(spark, rows):
    df = documents(spark, rows, EXTRA).repartition(3)
    bitmaps = line_dedup.keep_bitmaps(df, "doc_id", "text")
    want = _plain_lines(rows)
    shown = []
    for r in bitmaps.collect():
        kept = [i for run in r["keep"] for i in range(run["start"], run["start"] + run["length"])]
        gone = sorted(set(range(r["n_lines"])) - set(kept))
        assert r["n_dropped"] == len(gone) and kept == sorted(kept)
        assert all(a["start"] + a["length"] < b["start"]
                   for a, b in itertools.pairwise(r["keep"]))
        shown.append((r["doc_id"], r["n_lines"], gone))
    assert sorted(shown, key=repr) == sorted([(k, len(x), g) for k, x, g in want], key=repr)
    cut = line_dedup.drop_lines(df, "doc_id", "text", bitmaps)
    assert set(cut.columns) == {*df.columns, "n_dropped"}
    texts = sorted(((r["doc_id"], r["text"] or "", r["n_dropped"]) for r in cut.collect()), key=repr)
    assert texts == sorted(
        [(k, "\n".join(x for i, x in enumerate(lines) if i not in g), len(g))
         for k, lines, g in [(k, lines, set(g)) for k, lines, g in want]], key=repr)


def test_lines_equal_plain_python(spark):
    rng = random.Random(5)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "", "0123456789", "éàçôûéàçô",
                                                                  "éàçôûéàçôû", "\U0001f600" * 10]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {j} {rng.random()}"
                 for j in range(rng.randrange(0, 25))]
        lines = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 else x)
                 + rng.choice(["", "\r", "\xa0"]) for x in lines]
        rows.append((rng.randrange(-20, 120), "\n".join(lines)))
    rows += rows[:5]  # repeated rows
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, None)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    _check_lines(spark, rows)


def test_one_line_in_most_rows_and_a_very_long_text(spark):
    rows = [(i, "the same very common line\nown line of document %d\n" % i * 3) for i in range(3000)]
    long = [f"line {i % 700} of a long text" for i in range(60_000)]
    rows += [(10_000, "\n".join(long)), (10_001, "\n".join([*long, "one line more than that"]))]
    _check_lines(spark, rows)
    # a third of all rows in one hash: more than one slice
    lines = line_dedup.keyed_lines(documents(spark, rows, EXTRA), "doc_id", "text")
    assert line_dedup._slices(lines).count() >= 1


def test_lines_of_empty_tables(spark):
    for rows in ([], [(None, None)], [(1, None)], [(1, "a line on its own, repeated\n" * 2)]):
        _check_lines(spark, rows)


# --- filters ----------------------------------------------------------------------------


def _plain_audit(rows, labels):
    """Apply the filters in every order, as they would be run."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, x in labels if x == 1}
    failed = []
    for key, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if key is not None and first[text] < key:
            fails.add("E")
        failed.append(fails)
    out, shapley = {}, {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(k, f) for (k, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(k, f) for k, f in left if letter in f]
                left = [(k, f) for k, f in left if letter not in f]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in mine) - len(gone),
                    sum(f == {letter} for _, f in mine), sum(k in good for k, _ in gone if k is not None),
                    sum(k in toxic for k, _ in gone if k is not None)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def _check_audit(spark, rows, labels):
    schema = "doc_id long, text string, lang string, _hash string, mask string, part int, rows int"
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], schema).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, marks, "doc_id", "text", "lang").collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(got) == len(found) and got == _plain_audit(rows, labels)


def test_audit_equals_plain_python(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        vocabulary = rng.choice([5, 100, 100_000])
        text = " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 50, 199, 200, 300])))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += "\n#" + rng.choice(["", "\x0b%", "é"])
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    rows += rows[:4] + [(3, "another text of id 3", "en"), (5, rows[5][1], "de")]
    rows += [(None, rows[9][1], "en"), (None, None, None), (500, None, "en"), (501, "", "en")]
    rows += [(600 + i, t, "fr") for i, t in enumerate(ODD_TEXTS)]
    labels = [(rng.randrange(0, 700), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(300)]
    labels += [(None, 1, 1)]
    _check_audit(spark, rows, labels)


def test_audit_of_many_copies_and_empty_tables(spark):
    rows = [(i, "copied " * 300 if i % 3 else f"own {i} " * 120, "en") for i in range(600)]
    _check_audit(spark, rows, [(i, 1, i % 2) for i in range(0, 600, 7)])
    _check_audit(spark, [], [])
    _check_audit(spark, [(1, None, None)], [])


def test_word_and_symbol_filters(spark):
    texts = {"a " * 199: "AB", "a " * 200: "B", " ".join(f"x{i}" for i in range(200)): "",
             "": "A", "ABC": "AC", "x | y": "AD", "a\xa0b": "A"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", *[c.alias(n) for n, c in filter_audit.text_filters(F.col("t")).items()]).collect():
        assert "".join(n for n in "ABCD" if r[n]) == texts[r["t"]], r["t"][:20]


def test_line_digest(spark):
    one = spark.createDataFrame([(1, "a line that is long\nb"), (2, "b\n A LINE that is long ")],
                                "doc_id long, text string")
    cut = line_dedup.drop_lines(one, "doc_id", "text", line_dedup.keep_bitmaps(one, "doc_id", "text"))
    got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect()}
    assert got[2] == hashlib.sha256(b"b").hexdigest()
