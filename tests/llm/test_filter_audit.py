import itertools
import random
import re

import duckdb
import pytest

from labspark.llm.filter_audit import ORACLE, filter_orders, prefixes

SCHEMA = "doc_id long, text string, source string, part string, mask int, cells string, letter string"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "p", 7, "c", "A") for i, t, s in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")


def brute(rows, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        out |= {"D"} if re.search("[#$%&*|]", text) else set()
        copies = [j for j, t, _ in rows if (t or "") == text and j is not None and i is not None and j < i]
        return out | ({"E"} if copies else set())

    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, _ in labels if i is not None and t == 1}
    marked = [(i, s or "", fails(i, t or "")) for i, t, s in rows]
    out = {}
    for part in {s for _, s, _ in marked}:
        inside = [(i, f) for i, s, f in marked if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = inside
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in inside) - len(gone),
                    sum(f == {letter} for _, f in inside),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def corpus():
    rng = random.Random(5)
    long_text = " ".join(f"w{i}" for i in range(260))
    kinds = [long_text, "same " * 300, long_text.upper(), f"{long_text} 100%", "short", "", None, "\t \n", "Ab" * 30 + " #", "x\u00a0y z " * 90]
    rows = [(i, rng.choice(kinds), rng.choice(["src0"] * 5 + ["src1", "", None])) for i in range(90)]
    rows += [(90, "z" * 50_000 + " A" * 40_000, "src1"), (7, "short", "src0"), (7, "short", "src0"), (7, "short", "src1")]
    rows += [(None, "short", "src1"), (None, None, None), (-3, "short", "src1")]
    rows += [(100 + i, f"{long_text} own{i}", "clean") for i in range(4)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 110, 2)]
    return rows, [*labels, (4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x")]


def test_equals_brute_force(spark):
    rows, labels = corpus()
    out = filter_orders(*tables(spark, rows, labels))
    assert out.columns == ["part", "filter_order", "step", *COLUMNS]
    got = [((r.part, r.filter_order, r.step), [r[c] for c in COLUMNS]) for r in out.collect()]
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 4 and dict(got) == want
    # A part of clean documents has all its rows, with nothing removed.
    assert all(v[:2] == [4, 0] for k, v in got if k[0] == "clean")


def test_sql_equals_brute_force():
    rows, labels = corpus()
    rows = list({i: (i, t, s) for i, t, s in rows if i is not None}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [r[:3] for r in labels])
    got = con.execute(f"SELECT part, filter_order, step, {', '.join(COLUMNS)} FROM ({ORACLE})").fetchall()
    assert {r[:3]: list(r[3:]) for r in got} == brute(rows, labels)


def test_empty_tables(spark):
    assert filter_orders(*tables(spark, [], [])).count() == 0
    one = filter_orders(*tables(spark, [(1, None, None)], [])).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.good_lost for r in one} == {0}


@pytest.mark.parametrize("parts", [4000])
def test_recursion_has_no_row_limit(spark, parts):
    cells = spark.range(parts).selectExpr("cast(id as string) as part", "array(named_struct('mask', 3, 'n', 2L, 'good', 1L, 'toxic', 0L)) as cells")
    assert prefixes(cells).count() == 325 * parts
