"""What filters take from a corpus in every order in which they can be applied, by a recursive CTE.

Each text becomes a mask of the filters it fails, and each part of the corpus a handful of mask cells with
their document counts.  A recursive query starts with the empty prefix of every part and extends each prefix
by the letters it does not use yet; it joins the part's mask cells, carries the bits applied so far, and
every level of the recursion emits the metrics of its step.  Texts are read once, whatever the orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.storage import written

#: Filters in the order of their bits, with the condition under which a document fails; E follows from copies.
FILTERS = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * regexp_count(body, '[A-Z]') > 2 * length(body)",
    "D": "body rlike '[#$%&*|]'",
}
COPY = "E"
LETTERS = [*FILTERS, COPY]

_BLANK = r" \t\n\x0B\f\r"


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the bits of the filters that look at one text only."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.regexp_replace("body", f"^[{_BLANK}]+|[{_BLANK}]+$", "")
    bits = " + ".join(f"if({fails}, {1 << at}, 0)" for at, fails in enumerate(FILTERS.values()))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), body.alias("body"))
        .withColumn("bare", bare)
        .withColumn("words", F.when(F.col("bare") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("bare", f"[{_BLANK}]+")))
        .select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), F.expr(bits).alias("mask"))
    )


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): the documents of each part counted by mask, with those labelled good and toxic.

    Rows that agree in doc_id, part and text are counted together before any join, so that copies of one row
    meet as one.  The smallest doc_id of a text returns by (digest, doc_id), never by the digest of a text
    that half of the corpus may share.  A part has 32 cells at most.
    """
    rows = text_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
        .where("good or toxic")
    )
    rows = written(rows, "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = (
        rows.where("doc_id is not null")
        .join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
        .join(known, F.col("doc_id") == F.col("labelled"), "left")
        .select("part", F.expr(f"if(first is null, mask + {1 << len(FILTERS)}, mask)").alias("mask"), "n", "good", "toxic")
    )
    nameless = rows.where("doc_id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return (
        marked.union(nameless)
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0)")).alias("good"), F.sum(F.expr("if(toxic, n, 0)")).alias("toxic"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    )


def _total(what: str, where: str) -> str:
    """The sum of ``what`` over the cells for which ``where`` holds."""
    return f"aggregate(filter(cells, c -> {where}), 0L, (total, c) -> total + c.{what})"


def prefixes(cells: DataFrame) -> DataFrame:
    """(part, prefix, letter, and the metrics of its step) for every ordered choice of letters."""
    removed = "c.mask & before = 0 and c.mask & bit != 0"
    return cells.sparkSession.sql(
        f"""
        WITH RECURSIVE steps(part, prefix, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
          SELECT part, '', 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
          UNION ALL
          SELECT part, concat(prefix, letter), before | bit, letter,
                 {_total("n", "c.mask & (before | bit) = 0")}, {_total("n", removed)},
                 {_total("n", "c.mask & before != 0 and c.mask & bit != 0")}, {_total("n", "c.mask = bit")},
                 {_total("good", removed)}, {_total("toxic", removed)}
          FROM (
            SELECT s.part, s.prefix, s.applied AS before, next.letter, shiftleft(1, instr('{"".join(LETTERS)}', next.letter) - 1) AS bit, m.cells
            FROM steps s JOIN {{cells}} m ON s.part = m.part
            LATERAL VIEW explode(filter(array({", ".join(f"'{x}'" for x in LETTERS)}), x -> instr(s.prefix, x) = 0)) next AS letter
          )
        )
        SELECT * FROM steps LIMIT ALL
        """,
        cells=cells,
    ).where("prefix != ''").drop("applied")


def filter_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step.

    ``docs`` (doc_id, text, source), ``labels`` (doc_id, quality, toxic); other columns are ignored.  A null
    text is empty, a null source the empty part.  A part without any failing document still has all its
    rows; an empty table has none.  A row without doc_id is no copy of any other and has no label; rows that
    repeat a doc_id are counted each, and are no copies of one another; a document is good or toxic if any
    label row of its doc_id says so.
    ``shapley`` is what the filter removes summed over all orders, at whatever step it stands.
    """
    size = len(LETTERS)
    steps = written(prefixes(written(mask_cells(docs, labels), "audit-cells")), "audit-steps")
    at = F.length("prefix")
    # So many full orders begin with a prefix of a given length.
    orders = F.element_at(F.array(*(F.lit(math.factorial(size - k)).cast("long") for k in range(1, size + 1))), at)
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where(at == size).select(F.col("part"), F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    return (
        whole.withColumn("prefix", F.expr("left(filter_order, step)"))
        .join(steps, ["part", "prefix"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


_RE_WORD = r"[^\x20\x09-\x0D]+"

ORACLE = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_RE_WORD}') AS words FROM documents
), first AS (
  SELECT body, min(doc_id) AS doc_id FROM texts GROUP BY body
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT t.part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_extract_all(t.body, '[A-Z]')) > 2 * length(t.body) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t.body, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN t.doc_id > f.doc_id THEN 16 ELSE 0 END) AS mask, k.good, k.toxic
  FROM texts t JOIN first f ON t.body = f.body LEFT JOIN known k ON t.doc_id = k.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (
  SELECT letter, 1 << (ord - 1) AS bit FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 3, 4, 5]) AS ord)
), orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || letter FROM orders, letters WHERE instr(filter_order, letter) = 0
), steps AS (
  SELECT filter_order, step, letter, bit,
         (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE instr(left(filter_order, step - 1), l.letter) > 0)::INTEGER AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(filter_order) = 5) o JOIN letters ON letter = substr(filter_order, step, 1)
), counts AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counts
"""
