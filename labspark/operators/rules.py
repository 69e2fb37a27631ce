"""Text rules that come as a table: many literal terms in one pass over each text, patterns only where a term stands.

``rules(rule_id, literal, pattern, severity, message)``.  A rule is violated by a text that holds its literal,
ignoring case, and matches its pattern; either may be missing.  A rule with neither is violated by nothing, and
a rule with a pattern alone is tested on every text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_COLUMNS = ["rule_id", "literal", "pattern", "severity", "message"]
#: Characters of rules that one pass over the texts takes.
MOST_CHARS = 4_000_000
#: Characters that a rule counts beside its own.
_PER_RULE = 64


def _with_hits(texts: DataFrame, rules: Sequence[Row], patterns: bool) -> DataFrame:
    """``texts`` with the number of each rule whose literal they hold, one row for each."""
    numbers: dict[str, list[int]] = {}
    always = [i for i, r in enumerate(rules) if not r.literal]
    for i, r in enumerate(rules):
        if r.literal:
            numbers.setdefault(r.literal, []).append(i)
    kept = [f for f in texts.schema.fields if f.name != "_lowered" and (patterns or f.name != "_text")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for literal, of in numbers.items():
            automaton.add_word(literal, of)
        if numbers:
            automaton.make_automaton()
        for batch in batches:
            hits = []
            for text in batch.column("_lowered"):
                found = set(always)
                for _, of in automaton.iter(text.as_py()) if numbers else ():
                    found.update(of)
                hits.append(sorted(found))
            columns = [*(batch.column(c) for c in names), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_hits"])

    schema = T.StructType([*kept, T.StructField("_hits", T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(run, schema).select(*names, F.explode("_hits").alias("_rule"))


def rule_findings(
    docs: DataFrame,
    rules: DataFrame,
    id_column: str = "doc_id",
    text: str = "tex",
    keep: Sequence[str] = (),
    most: int = MOST_CHARS,
) -> DataFrame:
    """``<id>, <keep>, rule_id, severity, message`` of every violated rule of every text.

    The size of ``rules`` is measured first.  Up to ``most`` characters they go to every task as one automaton,
    which finds the literals of all rules while it reads a text once; a larger table is dealt out by hash in
    portions of about that size, with one pass over the texts for each.  Null texts violate nothing, rows of
    ``rules`` that repeat count once, and a pattern that is none is an error.
    """
    spark = docs.sparkSession
    usable = (
        rules.select(*RULE_COLUMNS)
        .withColumn("literal", F.when(F.col("literal") != "", F.lower("literal")))
        .filter("literal is not null or pattern is not null")
        .distinct()
    )
    chars = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in RULE_COLUMNS])
    size = usable.agg(F.sum(chars + _PER_RULE)).first()[0] or 0
    portions = max(1, -(-size // most))
    texts = docs.filter(F.col(text).isNotNull()).select(
        id_column, *keep, F.col(text).cast("string").alias("_text"), F.lower(text).alias("_lowered")
    )
    found = []
    for k in range(portions):
        portion = usable if portions == 1 else usable.filter(F.pmod(F.xxhash64(*RULE_COLUMNS), F.lit(portions)) == k)
        local = portion.collect()  # about ``most`` characters
        patterns = any(r.pattern is not None for r in local)
        numbered = T.StructType([T.StructField("_rule", T.IntegerType()), *usable.schema.fields])
        table = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(local)], numbered))
        hits = _with_hits(texts, local, patterns).join(table, "_rule")
        if patterns:
            hits = hits.filter(F.col("pattern").isNull() | F.regexp_like("_text", F.col("pattern")))
        found.append(hits.select(id_column, *keep, "rule_id", "severity", "message"))
    return reduce(DataFrame.unionByName, found)
