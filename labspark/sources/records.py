"""Records of delimited text whose quoted cells may go on over several lines.

A quote opens a cell only where a cell begins, so whether a line ends inside quotes depends on the delimiter
and on whether it began inside.  Each line is therefore a function of one bit, and functions compose: a block
of lines gives its end for both starts, blocks are composed along the file, and every line then knows where
its record began.  No file is read in order by one task.

Within a line a pair of quotes is first replaced by one character, so that every cell is found by a pattern
without nested repetition, whatever its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for a pair of quotes; a character that no text may hold.
PAIR = "﷐"
#: Stands for the delimiter of a line that is one cell.
NO_DELIMITER = "﷑"

LINE_BLOCK = "_line_block"
# The last cell of a line, if its quotes stay open at the end of the line.
_OPEN = f'^{PAIR}*+"[^"]*+\\z'


def block_of(row: str, block_rows: int) -> Column:
    return F.expr(f"`{row}` div {int(block_rows)}L")


def into_line_blocks(lines: DataFrame, block_rows: int) -> DataFrame:
    """The lines with their block, dealt out by file and block; those without are dropped."""
    # What a later join would ask for is asked here, so that both its sides share one exchange.
    known = F.col("dataset_id").isNotNull() & F.col(LINE_BLOCK).isNotNull()
    return lines.withColumn(LINE_BLOCK, block_of("row_idx", block_rows)).filter(known).repartition("dataset_id", LINE_BLOCK)


def _cell_pattern(delimiter: str) -> str:
    """One cell with its leading delimiter: quoted, quoted and empty, bare, missing, or open to the end."""
    d = "\\t" if delimiter == "\t" else delimiter
    quoted = f'{PAIR}*+"[^"]*+"[^{d}]*+'
    return f'{d}({quoted}|{PAIR}++(?!")[^{d}]*+|[^{d}"{PAIR}][^{d}]*+|(?={d}|\\z)|{PAIR}*+"[^"]*+\\z)'


def marked_cells(line: Column, delimiter: str) -> Column:
    """The cells of a line as written, pairs of quotes marked."""
    marked = F.concat(F.lit(delimiter), F.replace(line, F.lit('""'), F.lit(PAIR)))
    return F.regexp_extract_all(marked, F.lit(_cell_pattern(delimiter)), F.lit(1))


def unquoted(cell: Column) -> Column:
    """The text of a marked cell; what follows a closing quote is taken as written."""
    quote, pair = F.lit('"'), F.lit('""')
    pattern = f'(?s)^({PAIR}*+)"([^"]*+)"?(.*)$'
    parts = [F.regexp_extract(cell, pattern, i) for i in (1, 2, 3)]
    inside = F.concat(*(F.replace(p, F.lit(PAIR), quote) for p in parts[:2]), F.replace(parts[2], F.lit(PAIR), pair))
    # n pairs at the beginning are an opening quote, n - 1 quotes and a closing one.
    closed = F.regexp_extract(cell, f"(?s)^({PAIR}++)(.*)$", 1)
    rest = F.replace(F.regexp_extract(cell, f"(?s)^({PAIR}++)(.*)$", 2), F.lit(PAIR), pair)
    return (
        F.when(cell.rlike(f'^{PAIR}*+"'), inside)
        .when(cell.startswith(PAIR), F.concat(F.repeat(quote, F.length(closed) - 1), rest))
        .otherwise(F.replace(cell, F.lit(PAIR), pair))
    )


def ends_open(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return line.contains('"') & F.element_at(marked_cells(line, delimiter), -1).rlike(_OPEN)


def ends_open_by(line: Column, delimiter: Column, delimiters: list[str]) -> Column:
    """:func:`ends_open` for the delimiter that a row names; none is one cell."""
    out = F.when(delimiter.isNull(), ends_open(line, NO_DELIMITER))
    for d in delimiters:
        out = out.when(delimiter == d, ends_open(line, d))
    return F.coalesce(out, F.lit(False))


def joined_records(lines: DataFrame, delimiters: list[str], block_rows: int, carry: Sequence[str] = ()) -> DataFrame:
    """``dataset_id, delimiter, row_idx, line, unclosed`` of the records of ``lines`` (dataset_id, delimiter, row_idx, line).

    A record has the number of its first line; its lines are joined by a line feed.  Where the last record of
    a file never closes, nothing of the file is joined: every line stays alone and is ``unclosed``.
    ``carry`` names columns with one value per file and delimiter, which every record gets.  Lines have a file and a number.

    The lines come from :func:`into_line_blocks`, or go through it here, and all steps of a block keep to that shuffle.  Only records that cross
    the border of a block, one for each border at most, are brought together by a shuffle of their own.
    """
    file = ["dataset_id", "delimiter"]
    block = [*file, LINE_BLOCK]
    line = F.col("line")
    in_block = Window.partitionBy(*block).orderBy("row_idx")
    # From inside quotes a line goes on like one that begins with a quote.
    from_out = ends_open_by(line, F.col("delimiter"), delimiters)
    from_in = ~line.contains('"') | ends_open_by(F.concat(F.lit('"'), line), F.col("delimiter"), delimiters)
    blocked = lines if LINE_BLOCK in lines.columns else into_line_blocks(lines, block_rows)
    ends = (
        blocked.select(*block, "row_idx", "line", *carry)
        .withColumns({"from_out": from_out.cast("int"), "from_in": from_in.cast("int")})
        .withColumn("flips", (F.sum(F.expr("int(from_out = 1 and from_in = 0)")).over(in_block) % 2).cast("int"))
        # The state that the last line with one end for both starts leads to, but for the flips since.
        .withColumn("fixed", F.last(F.expr("if(from_out = from_in, from_out ^ flips, null)"), ignorenulls=True).over(in_block))
    )
    for start in (0, 1):
        after = F.coalesce("fixed", F.lit(start)).bitwiseXOR(F.col("flips"))
        ends = ends.withColumn(f"after_{start}", after).withColumn(f"before_{start}", F.lag(after, 1, start).over(in_block))
    along = Window.partitionBy(*file).orderBy(LINE_BLOCK)
    blocks = (
        ends.groupBy(*block)
        .agg(
            *(F.max_by(f"after_{s}", "row_idx").alias(f"end_{s}") for s in (0, 1)),
            *(F.max(F.expr(f"if(before_{s} = 0, row_idx, null)")).alias(f"first_{s}") for s in (0, 1)),
        )
        .withColumn("flips", (F.sum(F.expr("int(end_0 = 1 and end_1 = 0)")).over(along) % 2).cast("int"))
        .withColumn("fixed", F.last(F.expr("if(end_0 = end_1, end_0 ^ flips, null)"), ignorenulls=True).over(along))
        .withColumn("end", F.coalesce("fixed", F.lit(0)).bitwiseXOR(F.col("flips")))
        .withColumn("start", F.lag("end", 1, 0).over(along))
        .withColumn("began", F.expr("if(start = 0, first_0, first_1)"))
        .withColumn("carried", F.last("began", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("unclosed", F.last("end").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1)
        # The record that goes on in the next block.
        .withColumn("cut", F.when(F.lead("start").over(along) == 1, F.coalesce("began", "carried")))
        .select(*block, "start", "carried", "unclosed", "cut")
    )
    # A file has few delimiters.  Joined by file and block alone, the lines stay where they are.
    known = blocks.groupBy("dataset_id", LINE_BLOCK).agg(F.collect_list(F.struct("delimiter", "start", "carried", "unclosed", "cut")).alias("_known"))
    own = F.filter("_known", lambda k: k["delimiter"].eqNullSafe(F.col("delimiter")))
    placed = ends.join(known, ["dataset_id", LINE_BLOCK]).withColumn("_own", F.get(own, F.lit(0)))
    placed = placed.withColumns({c: F.col(f"_own.{c}") for c in ("start", "carried", "unclosed", "cut")})
    begins = F.expr("if(if(start = 0, before_0, before_1) = 0, row_idx, null)")
    record = F.coalesce(F.last(begins, ignorenulls=True).over(in_block), F.col("carried"))
    crosses = ~F.col("unclosed") & ((block_of("record", block_rows) != F.col(LINE_BLOCK)) | F.coalesce(F.col("record") == F.col("cut"), F.lit(False)))
    parts = placed.withColumn("record", F.when(F.col("unclosed"), F.col("row_idx")).otherwise(record)).withColumn("crosses", crosses)
    once = [F.max("unclosed").alias("unclosed"), *(F.any_value(c).alias(c) for c in carry)]
    rows = F.collect_list(F.struct("row_idx", "line"))
    inside = parts.filter("not crosses").groupBy(*block, "record").agg(rows.alias("parts"), *once).drop(LINE_BLOCK)
    cut = parts.filter("crosses").groupBy(*file, "record").agg(rows.alias("parts"), *once)
    joined = F.array_join(F.array_sort("parts")["line"], "\n")
    return inside.unionByName(cut).select(*file, F.col("record").alias("row_idx"), joined.alias("line"), "unclosed", *carry)
