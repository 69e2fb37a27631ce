"""Lines whose template recurs across documents, by a log-template tree, with DataFrame functions only.

A line falls through a tree of fixed depth: its token count, then its ``DEPTH`` leading tokens, tokens with a
digit counting as the variable field ``<*>``.  The lines of one leaf share a template that has a token where
more than half of the leaf's documents agree and a variable field elsewhere; a line belongs to it if enough
of its tokens stand in the template.  Below that the leaf has templates with one further variable field: masked
lines that are equal but for the token at one place, whatever else is in the leaf.  A line takes the one of most
documents.  Masked lines in neither are templates of their own.  A template found in ``MIN_DOCS`` documents is
boilerplate: all its lines but the first go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.storage import written

DEPTH = 3
MIN_DOCS = 5
#: A line belongs to its leaf's template if so many tenths of its tokens stand in the template.
TENTHS = 7

_BLANKS = r"[ \t\x0B\f\r]+"
#: From the beginning of a token only, and without going back, so that a token is read once.
_FIELD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _masked(line: Column) -> Column:
    """Tokens with one space between them, those with a digit as ``<*>``; most lines need neither pattern."""
    odd = line.rlike(r"[\t\x0B\f\r]|  ")
    plain = F.trim(F.when(odd, F.regexp_replace(line, _BLANKS, " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, _FIELD, "<*>")).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line_no, tokens) of every line that has a token."""
    return (
        docs.select("key", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("key", "doc_id", "line_no", _masked(F.col("line")).alias("masked"))
        .where("masked != ''")
        .select("key", "doc_id", "line_no", "masked", F.split("masked", " ").alias("tokens"))
    )


def _one_field(forms: DataFrame) -> DataFrame:
    """(leaf, form, group): forms of a leaf that are equal but for the token at one place.

    ``forms`` has a row for each form, with its tokens.  The rest of a form without one token is its hash, the
    exclusive or of its tokens with their places, less that token's; so a line of any length is read once.
    """
    own = F.transform("tokens", lambda token, at: F.xxhash64(at, token))
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    placed = forms.where(f"10 * (n - 1) >= {TENTHS} * n").select("leaf", "form", "docs", own.alias("own"))
    rest = (
        placed.select("leaf", "form", "docs", F.posexplode("own").alias("at", "own"), whole.alias("whole"))
        .where(f"at >= {DEPTH}")
        .select("leaf", "form", "docs", "at", F.col("whole").bitwiseXOR(F.col("own")).alias("rest"))
    )
    groups = (
        rest.groupBy("leaf", "at", "rest")
        .agg(F.sum("docs").alias("weight"), F.count("*").alias("forms"))
        .where(f"forms > 1 and weight >= {MIN_DOCS}")
    )
    return (
        rest.join(groups.drop("forms"), ["leaf", "at", "rest"])
        .groupBy("leaf", "form")
        .agg(F.max(F.struct("weight", (-F.col("at")).alias("before"), "rest")).alias("best"))
        .select("leaf", "form", F.xxhash64("best.before", "best.rest").alias("group"))
    )


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(key, line_no): the lines to drop from ``docs`` (key, doc_id, text).

    ``key`` identifies a document.  The first line of each recurring template, by doc_id and line number,
    stays, so the content of copies survives once.
    """
    found = written(
        _lines(docs).select(
            "key",
            "doc_id",
            "line_no",
            F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"),
            F.xxhash64("masked").alias("form"),
        ),
        "lines",
    )
    forms = written(
        found.select("leaf", "form", "key", "doc_id")
        .distinct()
        .groupBy("leaf", "form")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "key")).alias("first")),
        "forms",
    )
    # Lines of a document in one leaf may have several forms; the sum is at least the number of documents.
    mixed = forms.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count("*").alias("n")).where(f"n > 1 and total >= {MIN_DOCS}")
    spread = written(forms.join(mixed, "leaf").select("leaf", "form", "docs", "total", F.col("first.key").alias("key")), "mixed")
    texts = docs.join(spread.select("key").distinct(), "key", "left_semi")
    bodies = written(
        _lines(texts)
        .select("key", F.xxhash64("masked").alias("form"), "tokens")
        .join(spread, ["key", "form"])
        .dropDuplicates(["leaf", "form"])
        .select("leaf", "form", "docs", "total", F.size("tokens").alias("n"), "tokens"),
        "forms",
    )
    tokens = bodies.select("leaf", "form", "docs", "total", "n", F.posexplode("tokens").alias("at", "token"))
    constant = (
        tokens.groupBy("leaf", "at", "token")
        .agg(F.sum("docs").alias("weight"), F.first("total").alias("total"))
        .where("2 * weight > total")
        .select("leaf", "at", "token")
    )
    general = (
        tokens.join(constant, ["leaf", "at", "token"])
        .groupBy("leaf", "form", "n")
        .agg(F.count("*").alias("same"))
        .where(f"10 * same >= {TENTHS} * n")
        .select("leaf", "form")
    )
    # The template of a line: its leaf's, one with a further field, or its own form.
    wide = general.select("leaf", "form", F.lit(0).cast("long").alias("group"))
    wide = wide.union(_one_field(bodies.join(general, ["leaf", "form"], "left_anti")))
    template = F.coalesce("group", "form")
    named = written(
        found.join(wide, ["leaf", "form"], "left").select(
            "key", "doc_id", "line_no", "leaf", template.alias("template")
        ),
        "templates",
    )
    recurring = (
        named.select("leaf", "template", "key")
        .distinct()
        .groupBy("leaf", "template")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= MIN_DOCS)
    )
    first = named.groupBy("leaf", "template").agg(F.min(F.struct("doc_id", "key", "line_no")).alias("first"))
    return (
        named.join(recurring.join(first, ["leaf", "template"]), ["leaf", "template"])
        .where("key != first.key or line_no != first.line_no")
        .select("key", "line_no")
    )


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with recurring lines taken out of ``text``, and the counts of both.

    Adds ``n_lines`` and ``n_dropped`` (replacing columns of that name) and keeps all other columns and every
    row.  Lines are separated by a line feed.  Lines without a token always stay; a null text stays null and
    has no lines; a text that loses all its lines is empty.  Rows that repeat a doc_id and text count as one
    document; a row without doc_id comes before all others.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key = F.xxhash64("doc_id", "text")
    plain = docs.select(key.alias("key"), "doc_id", "text").where("text is not null")
    dropped = recurring_lines(plain).groupBy("key").agg(F.collect_set("line_no").alias("gone"))
    inner = docs.select(F.struct(*rest).alias("row"), key.alias("key")).join(dropped, "key", "left")
    lines = F.split("row.text", "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    )
    return inner.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in rest],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
    )


#: The same for ``documents`` with unique ids; strings stand where the operator compares hashes.
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS line_no, line,
         regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS masked
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
), t AS (
  SELECT *, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n,
         concat(len(string_split(masked, ' ')), ' ', array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ')) AS leaf
  FROM lines WHERE masked <> ''
), forms AS (
  SELECT leaf, masked, any_value(tokens) AS tokens, any_value(n) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY leaf, masked
), mixed AS (
  SELECT leaf, sum(docs) AS total FROM forms GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS}
), tok AS (
  SELECT leaf, masked, n, docs, total, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS ord FROM forms JOIN mixed USING (leaf)
), fixed AS (
  SELECT leaf, ord, token FROM tok GROUP BY leaf, ord, token HAVING 2 * sum(docs) > any_value(total)
), general AS (
  SELECT leaf, masked FROM tok JOIN fixed USING (leaf, ord, token) GROUP BY leaf, masked, n HAVING 10 * count(*) >= {TENTHS} * n
), placed AS (
  SELECT *, hash(ord, token) AS own FROM tok ANTI JOIN general USING (leaf, masked) WHERE 10 * (n - 1) >= {TENTHS} * n
), rest AS (
  SELECT leaf, masked, docs, ord, xor(own, bit_xor(own) OVER (PARTITION BY leaf, masked)) AS rest FROM placed
), one_field AS (
  SELECT leaf, ord, rest, sum(docs) AS weight FROM rest WHERE ord > {DEPTH} GROUP BY ALL HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS}
), best AS (
  SELECT leaf, masked, arg_max(chr(10) || ord || ' ' || rest, weight * 1000000 - ord) AS template
  FROM rest JOIN one_field USING (leaf, ord, rest) GROUP BY leaf, masked
), named AS (
  SELECT t.doc_id, t.line_no, t.leaf, CASE WHEN g.masked IS NOT NULL THEN '' ELSE coalesce(b.template, t.masked) END AS template
  FROM t LEFT JOIN general g ON t.leaf = g.leaf AND t.masked = g.masked LEFT JOIN best b ON t.leaf = b.leaf AND t.masked = b.masked
), recurring AS (
  SELECT leaf, template, min(doc_id * 1000000 + line_no) AS first FROM named GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), gone AS (
  SELECT doc_id, line_no FROM named JOIN recurring USING (leaf, template) WHERE doc_id * 1000000 + line_no <> first
)
SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
"""
