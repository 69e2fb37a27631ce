"""Protocol texts: forbidden terms, text rules, bibliography and citation rules, quality report.

All rules of a document are evaluated on its own row as constant expressions; no rule table is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import contains_any

# Terms that must not appear in a summary.
FORBIDDEN_TERMS = [
    "PL Generator",
    "Codex",
    "Claude",
    "Anthropic",
    "localhost",
    "Proxy",
    "SHA256",
    "Python-Analyse",
    "internal provenance",
    "serverseitig",
    "generated by",
]


@dataclass(frozen=True)
class TextRule:
    rule_id: str
    pattern: str
    severity: str
    message: str


_ESTIMATE = "Problematische Schätzformulierung"
_INTERNAL = "Interner Begriff"
# Patterns, severities and messages of the text rules.
TEXT_RULES = [
    TextRule("todo", r"%TODO|\bTODO\b", "warning", "TODO-Platzhalter"),
    TextRule("estimate_assumed", r"(?i)angenommen", "warning", _ESTIMATE),
    TextRule("estimate_guessed", r"(?i)geschätzt", "warning", _ESTIMATE),
    TextRule("estimate_typical", r"(?i)typischerweise\s+beträgt", "warning", _ESTIMATE),
    TextRule("estimate_plausible", r"(?i)plausibler\s+Wert", "warning", _ESTIMATE),
    TextRule("internal_pl_generator", r"(?i)PL\s+Generator", "warning", _INTERNAL),
    TextRule("internal_codex", r"(?i)Codex", "warning", _INTERNAL),
    TextRule("internal_claude", r"(?i)Claude", "warning", _INTERNAL),
    TextRule("internal_anthropic", r"(?i)Anthropic", "warning", _INTERNAL),
    TextRule("internal_localhost", r"(?i)localhost", "warning", _INTERNAL),
    TextRule("internal_proxy", r"(?i)Proxy", "warning", _INTERNAL),
    TextRule("internal_sha256", r"(?i)SHA256", "warning", _INTERNAL),
    TextRule("internal_python_analyse", r"(?i)Python-Analyse", "warning", _INTERNAL),
]
# Messages of the bibliography and citation rules (all errors).
BIBLIOGRAPHY_MISSING = "\\printbibliography fehlt"
BIBLIOGRAPHY_MISPLACED = "\\printbibliography steht nicht direkt vor \\end{document}"
CITATION_MISSING = "Zitierter Key fehlt in literatur.bib"
CITATION_LITERAL = "Literal-Citation-Key im sichtbaren Text gefunden."

_COMMENT = r"(?<!\\)((?:\\\\)*)%.*"  # a percent sign after an even number of backslashes
_CITE = r"\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\s*(?:\[[^\]]*\]\s*)*\{[^}]*\})+"
_KEY_CHARACTER, _STOP = r"[\p{L}\p{M}\p{N}_:.+/-]", "[.:+/-]"
_EVERY_ENTRY = "*"  # the key of a \\nocite that names the whole bibliography
_STOPS = ".:+/-"


def forbidden_terms(df: DataFrame, id_column: str, text: str, terms: Sequence[str] = FORBIDDEN_TERMS) -> DataFrame:
    """``id, term`` of every forbidden term in a text or serialised summary, ignoring case."""
    return df.select(id_column, F.explode(contains_any(F.col(text), list(terms))).alias("term"))


def violation(rule_id: str, severity: str, message: str, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.lit(message).alias("message"),
        (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
    )


def text_violations(text: Column, rules: Sequence[TextRule] = TEXT_RULES) -> Column:
    """Array of violated text rules, in rule order."""
    return F.array_compact(
        F.array(
            *[
                F.when(text.rlike(r.pattern), violation(r.rule_id, r.severity, r.message))
                for r in rules
            ]
        )
    )


def bibliography_violations(tex: Column) -> Column:
    tex = without_comments(tex)
    absent = ~tex.contains("\\printbibliography")
    placed = tex.rlike(r"\\printbibliography\s*\\end\{document\}")
    return F.array_compact(
        F.array(
            F.when(absent, violation("bibliography_missing", "error", BIBLIOGRAPHY_MISSING)),
            F.when(
                ~absent & ~placed,
                violation("bibliography_misplaced", "error", BIBLIOGRAPHY_MISPLACED),
            ),
        )
    )


def without_comments(tex: Column) -> Column:
    return F.when(tex.contains("%"), F.regexp_replace(tex, _COMMENT, "$1")).otherwise(tex)


def cited_keys(tex: Column) -> Column:
    """Distinct keys cited outside comments; a citation may have several groups of several keys."""
    commands = F.regexp_extract_all(without_comments(tex), F.lit(_CITE), F.lit(0))
    bare = F.transform(commands, lambda c: F.regexp_replace(c, r"\[[^\]]*\]", ""))
    groups = F.flatten(F.transform(bare, lambda c: F.regexp_extract_all(c, F.lit(r"\{([^}]*)\}"), F.lit(1))))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def standing_keys(tex: Column, keys: Column) -> Column:
    """The ``keys`` that stand in the text as plain words, outside comments and citation commands.

    A word is a run of key-like characters without the stops at its ends.  Only keys that the text contains at
    all are looked for by a pattern, so the text is never cut into words.
    """
    shown = F.when(tex.contains("\\"), F.regexp_replace(without_comments(tex), _CITE, " ")).otherwise(without_comments(tex))

    def stands(text: Column, key: Column) -> Column:
        word = F.concat(F.lit(f"(?<!{_KEY_CHARACTER}){_STOP}*\\Q"), key, F.lit(f"\\E{_STOP}*(?!{_KEY_CHARACTER})"))
        possible = key.rlike(f"^{_KEY_CHARACTER}+\\z") & (key == F.btrim(key, F.lit(_STOPS)))
        return text.contains(key) & possible & F.regexp_like(text, word)

    # The text is bound to a variable, so that it is made once for all keys.
    return F.get(F.transform(F.array(shown), lambda text: F.filter(keys, lambda key: stands(text, key))), F.lit(0))


def citations(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(cited_keys(F.col("tex"))).alias("key"))


def missing_citations(cited: DataFrame, bib: DataFrame, per_document: bool = True) -> DataFrame:
    """Cited keys without a bibliography entry.

    With one bibliography for all, the keys are counted first, so a key cited by every document
    reaches the anti join as one row.
    """
    cited = cited.filter(F.col("key") != _EVERY_ENTRY)
    if per_document:
        return cited.join(bib.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")
    counted = cited.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.join(bib.select("key").distinct(), "key", "left_anti")


def uncited_entries(cited: DataFrame, bib: DataFrame, per_document: bool = True) -> DataFrame:
    """Bibliography entries that nothing cites; a document that cites every entry leaves none."""
    keys = ["doc_id", "key"] if per_document else ["key"]
    left = bib.select(*keys).distinct().join(cited.select(*keys).distinct(), keys, "left_anti")
    every = cited.filter(F.col("key") == _EVERY_ENTRY)
    if per_document:
        return left.join(every.select("doc_id").distinct(), "doc_id", "left_anti")
    return left.join(every.select(F.lit(True).alias("_all")).limit(1), F.col("_all"), "left_anti")


def with_entries(docs: DataFrame, bib: DataFrame) -> DataFrame:
    """``docs`` with ``bib_keys``, the distinct keys of the document's own bibliography, bounded by its file."""
    entries = bib.groupBy("doc_id").agg(F.collect_set("key").alias("bib_keys"))
    empty = F.array().cast("array<string>")
    return docs.join(entries, "doc_id", "left").withColumn("bib_keys", F.coalesce("bib_keys", empty))


def key_violations(tex: Column, entries: Column) -> Column:
    """Array of cited keys that are missing and of literal keys of one document.

    A literal key is an entry of the document's bibliography that stands as a plain word in its text.
    """
    missing = F.array_except(cited_keys(tex), F.concat(entries, F.array(F.lit(_EVERY_ENTRY))))
    literal = F.array_distinct(standing_keys(tex, entries))
    return F.concat(
        F.transform(missing, lambda k: violation("citation_missing", "error", CITATION_MISSING, k)),
        F.transform(literal, lambda k: violation("citation_literal", "error", CITATION_LITERAL, k)),
    )


def _exploded(docs: DataFrame, found: Column, keep: Sequence[str]) -> DataFrame:
    return docs.select("doc_id", *keep, F.explode(found).alias("v")).select("doc_id", *keep, "v.*")


def citation_violations(docs: DataFrame, bib: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, <keep>, rule_id, severity, message, detail`` of cited keys that are missing and of literal keys."""
    return _exploded(with_entries(docs, bib), key_violations(F.col("tex"), F.col("bib_keys")), keep)


def violations(
    docs: DataFrame,
    bib: DataFrame | None = None,
    rules: Sequence[TextRule] = TEXT_RULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every violated rule of every document, one row each, with the columns ``keep`` of the document."""
    own = F.concat(text_violations(F.col("tex"), rules), bibliography_violations(F.col("tex")))
    if bib is None:
        return _exploded(docs, own, keep)
    keys = key_violations(F.col("tex"), F.col("bib_keys"))
    return _exploded(with_entries(docs, bib), F.concat(own, keys), keep)


def quality_report(docs: DataFrame, bib: DataFrame, rules: Sequence[TextRule] = TEXT_RULES) -> DataFrame:
    """``doc_id, n_errors, n_warnings, passed`` of every document; ``violations`` has the messages.

    Everything is counted on the document's own row, which its bibliography's keys are joined to.
    """
    own = F.concat(text_violations(F.col("tex"), rules), bibliography_violations(F.col("tex")))
    keys = key_violations(F.col("tex"), F.col("bib_keys"))
    # A projection of its own, so that the rules are tested once and not for each count.
    found = with_entries(docs, bib).select("doc_id", own.alias("_own"), F.size(keys).alias("_keys"))
    counted = found.select(
        "doc_id",
        (F.size(F.filter("_own", lambda v: v["severity"] == "error")) + F.col("_keys")).cast("bigint").alias("n_errors"),
        F.size(F.filter("_own", lambda v: v["severity"] == "warning")).cast("bigint").alias("n_warnings"),
    )
    return counted.withColumn("passed", F.col("n_errors") == 0)
