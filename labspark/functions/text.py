"""Text predicates and labels."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of catalog states.
STATUS_LABELS = {
    "active": "geprüft",
    "stub": "vorläufig",
    "context": "Kontext",
    "structured_paraphrase": "strukturierte Paraphrase",
}
# Display names of sources, by a part of the file name.
SOURCE_LABELS = {"rothmaler": "Rothmaler", "strasburger": "Strasburger"}

NO_ESCAPE = "\u0001"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that non-ASCII letters stay case-sensitive."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ascii_like(text: Column, pattern: str) -> Column:
    """LIKE with ASCII case folding, ``_`` and ``%`` as wildcards and no escape character."""
    folded = "".join(c.lower() if c in string.ascii_uppercase else c for c in pattern)
    return F.like(ascii_lower(text), F.lit(folded), F.lit(NO_ESCAPE))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for pair in STATUS_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(labels, status), status, F.lit(""))


def source_label(source: Column) -> Column:
    """The joint label if every known source is named, else the one named, else the raw text."""
    lowered = F.lower(source)
    named = F.array_compact(
        F.array(*[F.when(lowered.contains(k), F.lit(v)) for k, v in SOURCE_LABELS.items()])
    )
    return F.coalesce(
        F.when(F.size(named) > 0, F.array_join(named, " + ")), source, F.lit("")
    )


def clean_generated_text(text: Column) -> Column:
    """Remove an opening and a closing code fence and whatever precedes the document class."""
    body = F.regexp_replace(text, r"(?i)^```(?:latex|tex)?\s*", "")
    body = F.regexp_replace(body, r"\s*```\s*$", "")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    start = F.instr(body, "\\documentclass")
    return F.when(start > 1, F.substr(body, start)).otherwise(body)


def contains_any(text: Column, terms: list[str]) -> Column:
    """The terms found in ``text``, ignoring case, in list order."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(lowered.contains(term.lower()), F.lit(term)) for term in terms])
    )
