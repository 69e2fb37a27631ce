"""Secrets in texts, told from copied examples by who holds them, with DataFrame functions only.

Patterns give candidates with their places.  Candidate values are hashed and counted over the whole corpus by
distinct repositories and owners: a value that many owners hold is a copied example, a value of one owner is
a credential that may be live.  Some kinds are findings by themselves; looser kinds become findings only where
the value looks alive and belongs to one owner.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.storage import written

#: A value of so many owners is an example that was copied.
WIDE = 3
#: Values with more than one in so many of all candidates are joined by broadcast; there are fewer than that.
HOT = 1000
#: So many matches are put into one array before it is appended to the array of its text.
CHUNK = 256


class Kind(NamedTuple):
    name: str
    pattern: str
    #: Group of the pattern that is the value, and its least length.
    group: int
    least: int
    #: Every match holds this text.
    hint: str = ""
    #: A looser kind's value has so many distinct characters and a match of each of these patterns.
    distinct: int = 0
    classes: tuple[str, ...] = ()


_ANY = r"[^\x20\x09-\x0D:/@]"

# The patterns of the kinds that are findings by themselves.
BASE = [
    Kind(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # Both patterns match maximal runs, so their least length can stand in the pattern.
    Kind("access", "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    Kind("hex", "[0-9a-f]{16,}", 0, 16),
]
#: Findings where the value looks alive and one owner holds it: long mixed runs, passwords in addresses.
#: The scheme's length is bounded, as a long run of letters would be tried again from each of them.
LOOSE = [
    Kind("mixed", "[A-Za-z0-9+/_-]{20,}", 0, 20, "", 10, ("[0-9]", "[a-z]", "[A-Z]")),
    Kind("url", rf"[a-z][a-z0-9+.-]{{0,20}}://{_ANY}+:({_ANY}+)@", 1, 8, "://", 6, ("[0-9]",)),
]
KINDS = [k.name for k in BASE + LOOSE]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _matches(body: Column, kind: Kind) -> Column:
    """Array of (start, ord, end, value) of the matches in ``body``, in code points.

    The gaps between matches are the pieces of a split, so a match starts after all gaps and matches before it.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,value:string>>)")
    found = F.regexp_extract_all(body, F.lit(kind.pattern), 0)
    values = found if kind.group == 0 else F.regexp_extract_all(body, F.lit(kind.pattern), kind.group)
    # The gap after the last match stands alone; its match is null and fits nothing.
    pairs = F.arrays_zip(F.split(body, kind.pattern, -1), found, values)

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["0"])
        end = start + F.length(m["1"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind.name)).alias("ord"), end.alias("end"), m["2"].alias("value"))
        fits = F.length(m["2"]) >= kind.least
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def chunks(pairs: Column) -> Column:
        def chunk(state: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(pairs, k * CHUNK + 1, CHUNK), F.struct(state["at"].alias("at"), none.alias("out")), add)
            return _bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(state["out"], p["out"]).alias("out")))

        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
        return F.aggregate(numbers, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), chunk, lambda s: s["out"])

    holds = body.rlike(kind.pattern) & body.contains(kind.hint) if kind.hint else body.rlike(kind.pattern)
    spans = F.when(holds, _bound(pairs, chunks)).otherwise(none)
    return F.filter(spans, lambda s: _alive(s["value"], kind)) if kind.distinct else spans


def _alive(value: Column, kind: Kind) -> Column:
    out = F.size(F.array_distinct(F.split(value, ""))) >= kind.distinct
    for pattern in kind.classes:
        out = out & value.rlike(pattern)
    return out


def _merged(kinds: list[Kind]) -> Column:
    """The spans of ``kinds`` in order of place, with a hash for each value, so that no secret is written anywhere."""
    hashed = F.transform(
        F.concat(*(F.col(k.name) for k in kinds)),
        lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("hash")),
    )
    return F.array_sort(hashed)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(row_id, doc_id, owner, repository, base, loose) of each row of ``docs``, written to the shared folder.

    ``base`` and ``loose`` are arrays of (start, ord, end, hash).  Writing fixes ``row_id``, which tells rows
    with the same doc_id apart.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    found = texts.select("doc_id", "owner", "repository", *(_matches(F.col("body"), k).alias(k.name) for k in BASE + LOOSE))
    spans = found.select("doc_id", "owner", "repository", _merged(BASE).alias("base"), _merged(LOOSE).alias("loose"))
    return written(spans.withColumn("row_id", F.monotonically_increasing_id()), "secrets")


def _judged(table: DataFrame, wide: int) -> DataFrame:
    """(row_id, doc_id, is_base, span, repositories, owners, verdict) of every candidate of ``candidates``."""
    marked = F.concat(
        F.transform("base", lambda s: F.struct(F.lit(True).alias("is_base"), s.alias("span"))),
        F.transform("loose", lambda s: F.struct(F.lit(False).alias("is_base"), s.alias("span"))),
    )
    each = table.select("row_id", "doc_id", "owner", "repository", F.explode(marked).alias("x")).select(
        "row_id", "doc_id", "owner", "repository", "x.is_base", "x.span", F.col("x.span.hash").alias("hash")
    )
    counts = written(
        each.groupBy("hash").agg(
            F.count("*").alias("n"), F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners")
        ),
        "secret-owners",
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    facts = counts.withColumn(
        "verdict", F.when(F.col("owners") == 1, "owned").when(F.col("owners") >= wide, "copied").otherwise("shared")
    )
    hot = F.broadcast(facts.where(F.col("n") * HOT > total))  # fewer than HOT rows, whatever the input
    rows = each.drop("owner", "repository")
    seldom = rows.join(hot, "hash", "left_anti").join(facts.where(F.col("n") * HOT <= total), "hash")
    return rows.join(hot, "hash").unionByName(seldom).drop("n")


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """(doc_id, kind, start, end, value_hash, repositories, owners, verdict, finding): one row per candidate.

    ``docs`` (doc_id, text, ``owner``, ``repository``); other columns are ignored.  ``verdict`` is ``owned`` for
    a value of one owner, ``copied`` for one of ``wide`` owners or more, else ``shared``.  ``finding`` holds for
    the base kinds and for looser ones that are owned.  Null and empty texts have none; a null owner or
    repository is one called by the empty text.  Rows that repeat a doc_id have their own spans.
    """
    kinds = F.array(*map(F.lit, KINDS))
    return _judged(candidates(docs, owner, repository), wide).select(
        "doc_id",
        kinds[F.col("span.ord")].alias("kind"),
        F.col("span.start").alias("start"),
        F.col("span.end").alias("end"),
        F.hex("hash").alias("value_hash"),
        "repositories",
        "owners",
        "verdict",
        (F.col("is_base") | (F.col("verdict") == "owned")).alias("finding"),
    )


def secret_digests(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, their digest, all spans, and findings by verdict.

    Handles nulls, repeated rows and other columns as ``secret_spans``; a row without spans has zeros, empty
    ``spans`` and the digest of an empty text; an empty table has no rows.
    """
    table = candidates(docs, owner, repository)
    found = _judged(table, wide).where("is_base or verdict = 'owned'")
    by_row = found.groupBy("row_id").agg(
        F.collect_list(F.when(~F.col("is_base"), F.col("span"))).alias("added"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("owned", "shared", "copied")),
    )
    kinds = F.array(*map(F.lit, KINDS))

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["ord"]], s["start"], s["end"])), ",")

    def number(kind: Kind) -> Column:
        return F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(kind.name))).cast("long").alias(f"n_{kind.name}")

    both = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return table.join(by_row, "row_id", "left").select(
        "doc_id",
        *map(number, BASE),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(both).alias("spans"),
        *(F.coalesce(f"n_{v}", F.lit(0)).alias(f"n_{v}") for v in ("owned", "shared", "copied")),
    )


def oracle(wide: int = WIDE) -> str:
    """The same for ``documents`` with unique ids; values stand where the operator compares hashes."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def found(kind: Kind, order: int) -> str:
        alive = " AND ".join([f"len(list_distinct(string_split(value, ''))) >= {kind.distinct}", *(f"regexp_matches(value, '{c}')" for c in kind.classes)])
        pieces, p = "string_split_regex(body, {0})", quoted(kind.pattern)
        return f"""
  SELECT doc_id, owner, {order} AS ord, {quoted(kind.name)} AS kind, ends - length(found) AS start, ends AS "end", value FROM (
    SELECT doc_id, owner, i, found, value, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
      SELECT doc_id, owner, unnest({pieces.format(p)}[1:len(regexp_extract_all(body, {p}))]) AS gap, unnest(regexp_extract_all(body, {p})) AS found,
             unnest(regexp_extract_all(body, {p}, {kind.group})) AS value, generate_subscripts(regexp_extract_all(body, {p}), 1) AS i
      FROM texts WHERE regexp_matches(body, {p})))
  WHERE length(value) >= {kind.least} AND {alive}"""

    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS owner FROM documents
), cand AS ({" UNION ALL ".join(found(k, i) for i, k in enumerate(BASE + LOOSE))}
), judged AS (
  SELECT cand.*, owners, ord < {len(BASE)} AS is_base FROM cand JOIN (SELECT value, count(DISTINCT owner) AS owners FROM cand GROUP BY value) USING (value)
), by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, ord) FILTER (WHERE is_base) AS base,
         string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, ord) AS spans,
         count(*) FILTER (WHERE owners = 1) AS n_owned, count(*) FILTER (WHERE owners > 1 AND owners < {wide}) AS n_shared,
         count(*) FILTER (WHERE owners >= {wide}) AS n_copied
  FROM judged WHERE is_base OR owners = 1 GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN by_doc USING (doc_id)
"""
