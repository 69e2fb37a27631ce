"""Delimiter choice by plausibility and parsing of delimited lines.

Everything works on ``lines(dataset_id, row_idx, line)`` of any number of files with different headers.
What is known per file (header, delimiter, roles) is spread over the file's row blocks before it is joined
to the lines, so a file that holds a third of all lines is still parsed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.numeric import WHITESPACE, as_number, missing_to_null, strip
from labspark.operators.ordered import BLOCK_ROWS
from labspark.session import cut_lineage
from labspark.sources.records import LINE_BLOCK, NO_DELIMITER, block_of, ends_open, ends_open_by, into_line_blocks, joined_records, marked_cells, unquoted

# Separators considered, in order of preference at equal score.
DELIMITERS = [",", ";", "\t"]
# Weights of the plausibility score.
SCORE_NUMERIC_COLUMN = 10.0
SCORE_EMPTY_COLUMN = -5.0
SCORE_TEXT_COLUMN = -2.0

ERROR_EMPTY = "Leere Messdatei."
ERROR_STRUCTURE = (
    "CSV/TXT konnte nicht vollständig gelesen werden: Keine plausible Spaltenstruktur gefunden."
)



def _is_blank(line: Column) -> Column:
    return strip(line) == ""


def split_fields(line: Column, delimiter: Column) -> Column:
    """The fields of a record as an array; quotes are only looked at where the record has any."""
    result = F.when(delimiter.isNull(), F.transform(marked_cells(line, NO_DELIMITER), unquoted))
    for d in DELIMITERS:
        plain = F.split(line, d, -1)
        quoted = F.transform(marked_cells(line, d), unquoted)
        result = result.when(delimiter == d, F.when(line.contains('"'), quoted).otherwise(plain))
    return result


def _names(header: Column, delimiter: Column) -> Column:
    """Column names: empty ones get a position name, repeated ones the first suffix that no column uses."""
    named = F.transform(
        split_fields(header, delimiter),
        lambda name, i: F.when(name == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(
            name
        ),
    )

    def appended(earlier: Column, name: Column) -> Column:
        taken = F.concat(named, earlier)
        suffixed = F.transform(
            F.sequence(F.lit(1), F.size(named)), lambda k: F.concat(name, F.lit("."), k.cast("string"))
        )
        free = F.filter(suffixed, lambda other: ~F.array_contains(taken, other))
        own = F.when(F.array_contains(earlier, name), F.get(free, F.lit(0))).otherwise(name)
        return F.concat(earlier, F.array(own))

    return F.aggregate(named, F.array().cast("array<string>"), appended)


def candidates(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per (dataset, delimiter) worth trying; datasets without any text keep a NULL header.

    ``multiline`` tells whether quotes stay open at the end of any line.  A header that does so is the whole
    record; where its first line has no delimiter, all are tried.  The rows are few and are written to the
    checkpoint folder, so that files whose records are lines need nothing more.
    """
    line = F.when(~_is_blank(F.col("line")), F.col("line"))
    open_by = {d: F.max(ends_open(F.col("line"), d or NO_DELIMITER)) for d in [None, *DELIMITERS]}
    headers = lines.groupBy("dataset_id").agg(
        F.min_by(line, F.when(line.isNotNull(), F.col("row_idx"))).alias("header"),
        F.min(F.when(line.isNotNull(), F.col("row_idx"))).alias("header_idx"),
        F.max("row_idx").alias("last_idx"),
        F.array(*open_by.values()).alias("_open"),
    )
    header = F.col("header")
    present = F.array_compact(
        F.array(*[F.when(header.contains(d), F.lit(d)) for d in DELIMITERS])
    )
    tried = (
        F.when(F.size(present) > 0, present)
        .when(ends_open(header, NO_DELIMITER), F.array(*map(F.lit, DELIMITERS)))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    kinds = F.array(*[F.lit(d).cast("string") for d in DELIMITERS])
    found = cut_lineage(
        headers.select("*", F.posexplode(tried).alias("ord", "delimiter")).select(
            "dataset_id",
            "header",
            "header_idx",
            "last_idx",
            "ord",
            "delimiter",
            F.get("_open", F.coalesce(F.array_position(kinds, F.col("delimiter")), F.lit(0)).cast("int")).alias("multiline"),
        )
    )
    opened = found.filter(ends_open_by(header, F.col("delimiter"), DELIMITERS))
    if not opened.isEmpty():
        whole = _records(lines, opened, block_rows).join(
            opened.select("dataset_id", F.col("header_idx").alias("row_idx")).distinct(), ["dataset_id", "row_idx"]
        )
        whole = whole.filter("not unclosed").select("dataset_id", F.col("delimiter").alias("_d"), F.col("line").alias("_whole"))
        same = (F.col("f.dataset_id") == F.col("w.dataset_id")) & F.col("delimiter").eqNullSafe(F.col("_d"))
        joined = found.alias("f").join(whole.alias("w"), same, "left").select("f.*", "_whole")
        found = cut_lineage(joined.withColumn("header", F.coalesce("_whole", "header")).drop("_whole"))
    return found.withColumn("names", _names(F.col("header"), F.col("delimiter")))


def _records(lines: DataFrame, layouts: DataFrame, block_rows: int, *carry: str) -> DataFrame:
    """The records of those layouts' files, with their ``carry`` columns."""
    files = layouts.select("dataset_id", "delimiter", "header_idx", *carry)
    blocks = lines.select("dataset_id", block_of("row_idx", block_rows).alias(LINE_BLOCK)).distinct()
    chosen = into_line_blocks(lines, block_rows).join(blocks.join(files, "dataset_id"), ["dataset_id", LINE_BLOCK])
    return joined_records(chosen.filter("row_idx >= header_idx"), DELIMITERS, block_rows, ["header_idx", *carry])


def parse_rows(
    lines: DataFrame, layouts: DataFrame, *carry: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Data rows of every layout: ``dataset_id, delimiter, row_idx, fields, n_fields, malformed``.

    ``fields`` holds the texts as written, one per header column (more in an overlong row), NULL where
    the row is short.  A row is a record, whose quoted fields may hold line ends; its ``row_idx`` is that of
    its first line.  ``malformed`` rows leave a quote open.
    ``carry`` names further layout columns to put on every row.
    """
    layouts = layouts.filter("header is not null")
    line, delimiter = F.col("line"), F.col("delimiter")

    facts = layouts.withColumn("_width", F.size("names"))

    def known(chosen: DataFrame) -> DataFrame:
        # Row numbers may have wide gaps, so only blocks that hold lines take part.
        blocks = lines.select("dataset_id", block_of("row_idx", block_rows).alias(LINE_BLOCK)).distinct()
        spread = blocks.join(chosen.select("dataset_id", delimiter, "header_idx", "_width", *carry), "dataset_id")
        return lines.withColumn(LINE_BLOCK, block_of("row_idx", block_rows)).join(spread, ["dataset_id", LINE_BLOCK])

    if "multiline" in layouts.columns:
        single, several = facts.filter("not multiline"), facts.filter("multiline")
        kinds = {r.multiline for r in facts.select("multiline").distinct().collect()}
        data = known(single).withColumn("malformed", F.lit(False))
        if True in kinds:
            whole = _records(lines, several, block_rows, "_width", *carry).withColumnRenamed("unclosed", "malformed")
            data = data.unionByName(whole, allowMissingColumns=True) if False in kinds else whole
    else:
        data = known(facts).withColumn("malformed", ends_open_by(line, delimiter, DELIMITERS))
    data = (
        data.filter(F.col("row_idx") > F.col("header_idx"))
        .filter(~_is_blank(line) | F.coalesce(line.contains(delimiter), F.lit(False)))
        .withColumn("_raw", split_fields(line, delimiter))
    )
    gap = F.col("_width") - F.size("_raw")
    padded = F.when(
        gap > 0, F.concat("_raw", F.array_repeat(F.lit(None).cast("string"), gap))
    ).otherwise(F.col("_raw"))
    return data.select(
        "dataset_id",
        "delimiter",
        "row_idx",
        padded.alias("fields"),
        "_width",
        F.size("_raw").alias("n_fields"),
        "malformed",
        *carry,
    )


def score_candidates(lines: DataFrame, tried: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per candidate: usable or not, and the plausibility score over all rows of the file."""
    rows = parse_rows(lines, tried, "ord", block_rows=block_rows)
    cells = rows.select(
        "dataset_id",
        "ord",
        "malformed",
        (F.col("n_fields") > F.col("_width")).alias("overflow"),
        F.posexplode("fields").alias("col_idx", "raw"),
    )
    columns = cells.groupBy("dataset_id", "ord", "col_idx").agg(
        F.max("overflow").alias("overflow"),
        F.max("malformed").alias("malformed"),
        F.max(as_number(F.col("raw")).isNotNull()).alias("numeric"),
    )
    numeric, width = F.count_if("numeric"), F.count(F.lit(1))
    return columns.groupBy("dataset_id", "ord").agg(
        F.max("overflow").alias("overflow"),
        F.max("malformed").alias("malformed"),
        (
            numeric * SCORE_NUMERIC_COLUMN
            + (width - numeric) * (SCORE_EMPTY_COLUMN + SCORE_TEXT_COLUMN)
        ).alias("score"),
    )


def detect(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One layout per file: the chosen delimiter and header, or the reason why there is none.

    Columns ``dataset_id, header, header_idx, last_idx, delimiter, names, multiline, score, ref_accepts,
    error, reason``.  A negative score does not reject a file here; ``ref_accepts`` tells whether the strict
    rule (score at least zero) would have taken it.
    """
    tried = candidates(lines, block_rows)
    scored = score_candidates(lines, tried, block_rows)
    judged = tried.join(scored, ["dataset_id", "ord"], "left")
    usable = F.col("score").isNotNull() & ~F.col("overflow") & ~F.col("malformed")
    score = F.when(usable, F.col("score")).alias("score")
    per_candidate = judged.select(
        "dataset_id",
        "header",
        "header_idx",
        "last_idx",
        F.struct(
            usable.cast("int").alias("usable"), score, (-F.col("ord")).alias("preference")
        ).alias("merit"),
        F.struct(
            "delimiter",
            "names",
            "header",
            "multiline",
            score,
            usable.alias("usable"),
            F.when(F.col("header").isNull(), "empty")
            .when(F.col("score").isNull(), "no_rows")
            .when(F.col("malformed"), "unterminated_quote")
            .when(F.col("overflow"), "row_overflow")
            .alias("reason"),
        ).alias("choice"),
    )
    best = per_candidate.groupBy("dataset_id").agg(
        F.min("header").alias("header"),
        F.first("header_idx").alias("header_idx"),
        F.first("last_idx").alias("last_idx"),
        F.max_by("choice", "merit").alias("choice"),
    )
    found = F.col("choice.usable")
    return best.select(
        "dataset_id",
        F.coalesce("choice.header", "header").alias("header"),
        "header_idx",
        "last_idx",
        F.when(found, F.col("choice.delimiter")).alias("delimiter"),
        F.when(found, F.col("choice.names")).alias("names"),
        F.coalesce("choice.multiline", F.lit(False)).alias("multiline"),
        F.col("choice.score").alias("score"),
        F.coalesce(F.col("choice.score") >= 0, F.lit(False)).alias("ref_accepts"),
        F.when(F.col("header").isNull(), ERROR_EMPTY)
        .when(~found, ERROR_STRUCTURE)
        .alias("error"),
        F.when(~found, F.col("choice.reason")).alias("reason"),
    )


def accepted(layouts: DataFrame) -> DataFrame:
    return layouts.filter("error is null")


def errors(layouts: DataFrame) -> DataFrame:
    return layouts.filter("error is not null").select("dataset_id", "error", "reason")


def to_cells(rows: DataFrame) -> DataFrame:
    """Long form ``cells(dataset_id, row_idx, col_idx, raw, num)``: files with any headers in one table.

    ``raw`` is NULL where the cell is missing, ``num`` where it is no number.
    """
    cells = rows.select("dataset_id", "row_idx", F.posexplode("fields").alias("col_idx", "_text"))
    return cells.select(
        "dataset_id",
        "row_idx",
        "col_idx",
        missing_to_null(F.col("_text")).alias("raw"),
        as_number(F.col("_text")).alias("num"),
    )


def column_names(layouts: DataFrame) -> DataFrame:
    """``dataset_id, col_idx, column``."""
    return accepted(layouts).select("dataset_id", F.posexplode("names").alias("col_idx", "column"))
