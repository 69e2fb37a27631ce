"""Rules given as a table, against brute force."""

import random
import re

import pytest

from labspark.operators.rules import rule_findings

RULES = "rule_id string, literal string, pattern string, severity string, message string"


def brute(texts, rules):
    out = []
    for i, text in texts:
        for rule_id, literal, pattern, severity, message in dict.fromkeys(rules):
            if text is None or (not literal and pattern is None):
                continue
            if (not literal or literal.lower() in text.lower()) and (pattern is None or re.search(pattern, text)):
                out.append((i, rule_id, severity, message))
    return sorted(out, key=str)


def found(spark, texts, rules, **more):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in texts], "doc_id long, tex string, lang string, literal string").repartition(3)
    out = rule_findings(docs, spark.createDataFrame(rules, RULES), **more)
    assert out.columns == ["doc_id", "rule_id", "severity", "message"]
    return sorted((tuple(r) for r in out.collect()), key=str)


TEXTS = [(1, "A TODO here, todos there"), (2, None), (3, ""), (4, "geschätzt: ÄHRE, ähren"), (None, "todo"), (5, "abcabc"), (5, "abcabc"), (6, "todo " * 50_000)]
CASES = [
    ("todo", "TODO", None, "warning", "a"),
    ("todo", "TODO", None, "warning", "a"),
    ("word", "todo", r"(^|\W)todo(\W|$)", "error", "b"),
    ("ear", "Ähre", None, "warning", None),
    ("inner", "bca", None, "warning", "c"),
    ("outer", "abcabc", None, "warning", "c"),
    ("suffix", "c", None, "warning", "c"),
    ("pattern", None, "^[Ag]", "error", "d"),
    ("empty literal", "", "z", "error", "d"),
    ("nothing", None, None, "error", "d"),
    ("nothing either", "", None, "error", "d"),
    (None, "abc", None, None, None),
]


@pytest.mark.parametrize("most", [300, 1_000_000])
def test_every_rule_of_every_text(spark, most):
    assert found(spark, TEXTS, CASES, most=most) == brute(TEXTS, CASES)


def test_many_literals(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcd", k=r.randint(2, 6))) for _ in range(600)]
    rules = [(f"r{i}", w, f"{w}[abc]" if i % 3 == 0 else None, "warning", "m") for i, w in enumerate(words)]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(60)]
    assert found(spark, texts, rules) == brute(texts, rules)


def test_empty_tables_and_kept_columns(spark):
    assert found(spark, TEXTS, CASES[:0]) == []
    assert found(spark, TEXTS[:0], CASES) == []
    docs = spark.createDataFrame([(1, "todo", "de")], "doc_id long, tex string, lang string")
    out = rule_findings(docs, spark.createDataFrame(CASES[:1], RULES), keep=["lang"])
    assert [tuple(r) for r in out.collect()] == [(1, "de", "todo", "warning", "a")]


def test_rules_reach_the_tasks_by_broadcast_only(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, tex string")
    plan = rule_findings(docs, spark.createDataFrame(CASES, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan
