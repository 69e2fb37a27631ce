"""Every operator as a query over the given tables.

The tables play the parts of the data model: runs of consecutive events are measurement files,
an event type or a user is a pendulum trace, parts are taxa, line items are their features,
documents are protocols.  All queries use the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions import propagation
from labspark.functions.numeric import as_number, finite
from labspark.functions.regression import linear_fit
from labspark.functions.text import clean_generated_text
from labspark.operators import catalog, documents, payload, physics, profile, quality, report
from labspark.operators import pendulum as p
from labspark.operators import roles as role_ops
from labspark.operators.rules import rule_findings
from labspark.plans.analysis import Analysis, analyse, measurement_rows
from labspark.plans.pendulum_run import evaluate_traces
from labspark.session import checkpoint_dir, cut_lineage
from labspark.sinks.ordered import read_ordered
from labspark.sources import delimited, tracking
from labspark.sources.lines import read_lines as read_text_lines
from labspark.sources.tables import read_bibliographies
from labspark.streaming.arrival import analyse_arrivals, read_arrivals, stream_files
from labspark.streaming.slices import late_samples, read_slices, slice_arrivals

Query = Callable[[SparkSession, str], DataFrame]
RUN_EVENTS = 200
EPOCH = "2024-01-01 00:00:00"  # the times of the events have no zone
# Headers of the derived measurement files, by run number modulo six: (delimiter, header).
RUN_KINDS = [
    (",", "time,angle,k,event_type"),
    (";", "zeit;winkel;k;event_type"),
    ("\t", "t\tphi\tk\tevent_type"),
    (",", "time,x,y,event_type"),
    (";", "frequency_Hz;peak_spacing_m;k;label"),
    (",", "a,b;unit,c,label"),
]
SEARCHES = ["red", "RING", "_old%plate", "brand#1", "", "42"]
EXTRA_RULES = [
    documents.TextRule("licence", r"(?i)licen[sc]e", "error", "Lizenzhinweis"),
    documents.TextRule("mail", r"[a-z0-9._]+@[a-z0-9.]+", "warning", "Adresse"),
]
EXTRA_TERMS = ["apache", "license", "copyright", "example.com"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_seconds() -> Column:
    """Exact seconds of an event since the start of 2024, with six decimals."""
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(EPOCH)), F.col("ts"))
    return (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")


def measurement_lines(events: DataFrame) -> DataFrame:
    """Runs of consecutive events as text lines of measurement files with six kinds of header."""
    run = F.expr(f"event_id div {RUN_EVENTS}")
    place = F.col("event_id") % RUN_EVENTS + 1
    kind = (run % len(RUN_KINDS)).cast("int")
    delimiter = F.get(F.array(*[F.lit(d) for d, _ in RUN_KINDS]), kind)
    header = F.get(F.array(*[F.lit(names) for _, names in RUN_KINDS]), kind)

    def printed(number: Column) -> Column:
        text = number.cast("string")
        return F.when(delimiter == ",", text).otherwise(F.replace(text, F.lit("."), F.lit(",")))

    swapped = kind == 4
    parts = events.select(
        run.alias("dataset_id"),
        place.alias("place"),
        header.alias("header"),
        delimiter.alias("d"),
        swapped.alias("swapped"),
        printed(event_seconds()).alias("t"),
        printed(F.col("value")).alias("v"),
        F.get_json_object("props", "$.k").alias("k"),
        F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("")).alias("kind"),
    )
    first = F.when(F.col("swapped"), F.col("k")).otherwise(F.col("t"))
    third = F.when(F.col("swapped"), F.col("t")).otherwise(F.col("k"))
    line = F.concat(first, "d", "v", "d", third, "d", "kind")
    row = F.struct(F.col("place").alias("row_idx"), line.alias("line"))
    head = F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.col("header").alias("line"))
    lines = F.when(F.col("place") == 1, F.array(head, row)).otherwise(F.array(row))
    return parts.select("dataset_id", F.explode(lines).alias("l")).select("dataset_id", "l.*")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement_lines(table(spark, sf_dir, "events"))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    layouts = cut_lineage(delimited.detect(lines))
    return delimited.to_cells(measurement_rows(lines, layouts)), delimited.column_names(layouts)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return measurement_rows(lines, cut_lineage(delimited.detect(lines)))


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyse(_lines(spark, sf_dir), run_metadata(table(spark, sf_dir, "events")))


def run_metadata(events: DataFrame) -> DataFrame:
    """Metadata per run, from its first event: a unit, an angular velocity or nothing."""
    first = events.filter(F.col("event_id") % RUN_EVENTS == 0)
    run = F.expr(f"event_id div {RUN_EVENTS}")
    pairs = (
        F.when(run % 4 == 0, F.create_map(F.lit("angle_unit"), F.lit("Rad")))
        .when(
            run % 4 == 1,
            F.create_map(
                F.lit("omega_mess_rad_s"),
                (F.col("value") / 1_000_000).cast("string"),
                F.lit("mass"),
                F.lit("5"),
            ),
        )
        .when(run % 4 == 2, F.create_map(F.lit("angle_unit"), F.lit("deg")))
    )
    return first.select(run.alias("dataset_id"), pairs.alias("metadata"))


def traces(events: DataFrame, key: str) -> DataFrame:
    """Events as pendulum samples of the trace ``key``; file order is the event order."""
    return events.select(
        key,
        F.col("event_id").alias("row_idx"),
        event_seconds().cast("double").alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        (F.col("value") + 80).alias("area"),
    )


def _traces(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return traces(table(spark, sf_dir, "events"), key)


def taxa(part: DataFrame) -> DataFrame:
    status = F.create_map(
        *[
            F.lit(v)
            for pair in {
                "STANDARD": "active",
                "MEDIUM": "stub",
                "SMALL": "context",
                "LARGE": "structured_paraphrase",
                "ECONOMY": "deprecated",
            }.items()
            for v in pair
        ]
    )
    ranks = F.array(*[F.lit(r) for r in ("species", "genus", "hybrid", "family")])
    sources = F.array(
        *[F.lit(s) for s in ("Rothmaler_1.pdf", "strasburger.pdf", "rothmaler+Strasburger.pdf", "andere.pdf")]
    )
    scope = (
        F.when(F.col("p_size") % 10 == 0, catalog.HIDDEN_SCOPE)
        .when(F.col("p_size") % 10 == 1, f"field|{catalog.HIDDEN_SCOPE}")
        .when(F.col("p_size") % 10 < 6, "field|photo")
    )
    return part.select(
        F.col("p_partkey").cast("string").alias("taxon_id"),
        F.col("p_name").alias("scientific_name"),
        F.col("p_brand").alias("german_name"),
        F.get(ranks, F.col("p_size") % 4).alias("rank"),
        F.try_element_at(status, F.col("p_type")).alias("status"),
        scope.alias("app_scope"),
        F.nullif("p_brand", F.lit("Brand#3")).alias("family"),
        F.get(sources, (F.col("p_partkey") % 4).cast("int")).alias("source_pdf"),
    )


def features(lineitem: DataFrame) -> DataFrame:
    def graded(high: Column, medium: Column) -> Column:
        return F.when(high, "high").when(medium, "medium").otherwise("low")

    stray = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 10 == 0)
    owner = F.col("l_partkey").cast("string")
    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return lineitem.select(
        F.concat_ws("-", *ids).alias("feature_id"),
        F.when(stray, F.concat(F.lit("x"), owner)).otherwise(owner).alias("taxon_id"),
        F.col("l_returnflag").alias("organ"),
        F.col("l_linestatus").alias("feature_group"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("character"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("state"),
        graded(F.col("l_quantity") >= 34, F.col("l_quantity") >= 17).alias("diagnostic_weight"),
        graded(F.col("l_discount") >= 0.07, F.col("l_discount") >= 0.03).alias("visibility_in_photo"),
        F.when(F.col("l_tax") > 0.04, "Band 2").alias("source_note"),
    )


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return taxa(table(spark, sf_dir, "part")), features(table(spark, sf_dir, "lineitem"))


def protocols(docs: DataFrame) -> DataFrame:
    """Documents as protocol texts: every text whole, with a citation and an ending that varies."""
    first = F.lower(F.regexp_extract("text", r"\p{L}+", 0))
    ending = (
        F.when(F.col("doc_id") % 4 == 1, "\n\\printbibliography\n\\end{document}")
        .when(F.col("doc_id") % 4 == 2, "\n\\printbibliography siehe oben \\end{document}")
        .when(F.col("doc_id") % 4 == 3, "\n% \\cite{nirgends} TODO\n\\printbibliography \\end{document}")
        .otherwise("")
    )
    return docs.select(
        "doc_id",
        "lang",
        F.concat("text", F.lit(" \\cite[S.~1]{"), first, F.lit(", quelle2023}"), ending).alias("tex"),
    )


def bibliography(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the documents with a label: the first word (good quality) or ``quelle2023`` and ``the``."""
    first = F.lower(F.regexp_extract("text", r"\p{L}+", 0))
    keys = F.when(F.col("quality") == 1, F.array(first, F.lit("quelle2023"))).otherwise(
        F.array(F.lit("quelle2023"), F.lit("the"))
    )
    return docs.join(labels, "doc_id").select("doc_id", F.explode(keys).alias("key"))


def _protocols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return protocols(docs), bibliography(docs, table(spark, sf_dir, "labels"))


def typed_payloads(events: DataFrame) -> DataFrame:
    """Events as nested payloads with raw fields at several depths."""
    k = F.get_json_object("props", "$.k").cast("int")
    blocks = F.array(
        F.struct(
            F.lit("a").alias("id"),
            F.struct(k.alias("k"), F.col("event_type").alias("csv")).alias("content"),
        ),
        F.struct(
            F.lit("b").alias("id"),
            F.struct(
                (k + 1).alias("k"), F.nullif("event_type", F.lit("view")).alias("csv")
            ).alias("content"),
        ),
    )
    return events.select(
        "event_id",
        F.struct(
            F.col("event_type").alias("experiment_title"),
            blocks.alias("selected_analysis_blocks"),
            F.struct(F.col("user_id").alias("user"), F.lit("geheim").alias("file_content")).alias("metadata"),
            F.when(k % 2 == 0, F.col("event_type")).alias("raw_csv"),
        ).alias("payload"),
    )


def _mean_digits(mean: Column) -> Column:
    """Single precision, so that sums taken in another order compare equal at any magnitude."""
    return mean.cast("float")


# ── measurement files ────────────────────────────────────────────────────────────────────────────


def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = linear_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select(
        "l_returnflag",
        "n",
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 3).alias("intercept"),
        F.round("r_squared", 8).alias("r_squared"),
        F.round("slope_stderr", 6).alias("slope_stderr"),
        F.round("intercept_stderr", 5).alias("intercept_stderr"),
    )


def regression_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = linear_fit(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id").cast("double"), "value", True)
    return fit.select("user_id", "n", F.round("p_value", 6).alias("p_value"))


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.wide_stats(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    )
    return stats.select(
        "l_returnflag",
        "column",
        "n",
        F.round("mean", 5).alias("mean"),
        F.round("sample_std", 5).alias("sample_std"),
        F.round("sem", 6).alias("sem"),
        F.col("min") + 0.0,
        "max",
    ).withColumnRenamed("(min + 0.0)", "min")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    return profile.numeric_stats(cells).join(names, ["dataset_id", "col_idx"]).select(
        "dataset_id",
        "col_idx",
        "column",
        "n",
        _mean_digits(F.col("mean")).alias("mean"),
        F.round("sample_std", 4).alias("sample_std"),
        F.round("sem", 5).alias("sem"),
        "min",
        "max",
        "nonfinite_count",
    )


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    return profile.column_profile(cells).join(names, ["dataset_id", "col_idx"])


def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    summary = profile.missing_summary(profile.missing_per_column(cells), names)
    return summary.select(
        "dataset_id", "total_missing_values", F.explode("missing_values_per_column").alias("column", "missing_count")
    )


def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    overview = profile.dataset_overview(profile.counts_per_column(cells), names)
    return overview.withColumn("detected_numeric_columns", F.array_join("detected_numeric_columns", "|"))


def numeric_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed with a decimal comma, and spoilt in every seventh part, read back as numbers."""
    printed = F.translate(F.col("p_retailprice").cast("string"), ".", ",")
    raw = (
        F.when(F.col("p_partkey") % 7 == 0, F.concat(printed, F.lit(",5")))
        .when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("  +"), printed, F.lit("e1 ")))
        .when(F.col("p_partkey") % 7 == 2, F.concat(printed, F.lit("d")))
        .otherwise(printed)
    )
    return table(spark, sf_dir, "part").select("p_partkey", as_number(raw).alias("num"))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters per measurement file."""
    return _lines(spark, sf_dir).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.detect(_lines(spark, sf_dir)).select(
        "dataset_id",
        "delimiter",
        F.array_join("names", "|").alias("names"),
        "score",
        "ref_accepts",
        "error",
    )


def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    return cells.groupBy("dataset_id", "col_idx").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("raw").alias("n_raw"),
        F.count("num").alias("n_num"),
        F.round(F.sum("num"), 3).alias("total"),
    )


def hard_lines(events: DataFrame) -> DataFrame:
    """Runs of events as files with what goes wrong in practice, one kind per run number modulo seven.

    Repeated names that meet a suffix; quoted cells, an empty name and a token for missing; one column with
    quoted commas; a row that is too long; a quote that stays open; a blank first line, short rows and
    infinite cells; a name and cells that go on over two or three lines.
    """
    run, place = F.expr(f"event_id div {RUN_EVENTS}"), F.col("event_id") % RUN_EVENTS + 1
    kind, text = run % 7, place.cast("string")
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(kind == 0, F.concat_ws(",", k, F.lit(""), text))
        .when(kind == 1, F.concat(F.lit('"1,5","sagt ""'), "event_type", F.lit('""",NA')))
        .when(kind == 2, F.concat(F.lit('"'), k, F.lit(',5"')))
        .when(kind == 3, F.when(place == 5, "1,2,3,4").otherwise("1,2,3"))
        .when(kind == 4, F.when(place == 3, '"abc').otherwise("1"))
        .when(kind == 5, F.when(place % 3 == 0, "inf;1").when(place % 3 == 1, text).otherwise(F.concat(text, F.lit(";-inf"))))
        .when(place % 3 == 0, F.concat(k, F.lit(';"sagt ""'), "event_type", F.lit('""')))
        .when(place % 3 == 1, F.concat(k, F.lit(";kurz;"), text))
        .otherwise(F.concat(k, F.lit(';"')))
    )
    headers = ["x,x,x.1", 'a,"b,c",', "wert", "a,b,c", "wert", "t;v", 'k;"notiz']
    header = F.element_at(F.array(*map(F.lit, headers)), (kind + 1).cast("int"))

    def numbered(at: Column | int, text: Column) -> Column:
        return F.struct((place * 4 + at).alias("row_idx"), text.alias("line"))

    row = numbered(0, line)
    more = F.when(kind != 6, F.array(row)).otherwise(
        F.when(place % 3 == 0, F.array(row, numbered(1, F.concat(F.lit('und; mehr";'), text))))
        .when(place % 3 == 1, F.array(row))
        .otherwise(F.array(row, numbered(1, F.lit("")), numbered(2, F.concat(F.lit('";'), text))))
    )
    first = F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.lit("  ").alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("row_idx"), header.alias("line")),
    )
    second = F.array(F.struct(F.lit(2).cast("bigint").alias("row_idx"), F.lit('lang";p').alias("line")))
    top = F.when(kind == 6, F.concat(first, second)).otherwise(first)
    lines = F.when(place == 1, F.concat(top, more)).otherwise(more)
    return events.select(run.alias("dataset_id"), F.explode(lines).alias("l")).select("dataset_id", "l.*")


def hard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of difficult files by column, and the reasons of those that cannot be read.

    Blocks are short, so that every file is cut into more than four.
    """
    lines = hard_lines(table(spark, sf_dir, "events"))
    block_rows = RUN_EVENTS
    layouts = cut_lineage(delimited.detect(lines, block_rows))
    cells = delimited.to_cells(measurement_rows(lines, layouts, block_rows))
    names = delimited.column_names(layouts)
    read = (
        cells.groupBy("dataset_id", "col_idx")
        .agg(
            F.count("raw").alias("n_raw"),
            F.count("num").alias("n_num"),
            F.count_if(F.abs("num") == float("inf")).alias("n_infinite"),
            F.round(F.sum(finite(F.col("num"))), 3).alias("total"),
        )
        .join(names, ["dataset_id", "col_idx"])
    )
    failed = delimited.errors(layouts).select("dataset_id", "reason")
    return read.unionByName(failed, allowMissingColumns=True)


def document_lines(docs: DataFrame) -> DataFrame:
    """Each source as one file with a row per document, whose whole text is one quoted cell."""
    place = F.shiftleft("doc_id", 20)
    quoted = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",'), "lang")
    head = F.struct(F.lit(-1).cast("bigint").alias("row_idx"), F.lit("doc_id,text,lang").alias("line"))
    rows = docs.select("source", F.posexplode(F.split(quoted, "\n")).alias("at", "line"), place.alias("place")).select(
        F.col("source").alias("dataset_id"), (F.col("place") + F.col("at")).alias("row_idx"), "line"
    )
    heads = docs.select(F.col("source").alias("dataset_id")).distinct().select("dataset_id", head.alias("h")).select("dataset_id", "h.*")
    return rows.unionByName(heads)


def multiline_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the documents, read back from cells that go on over any number of lines."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    block_rows = 1 << 26
    layouts = cut_lineage(delimited.detect(lines, block_rows))
    rows = delimited.parse_rows(lines, delimited.accepted(layouts), block_rows=block_rows)
    number, text, lang = (F.get("fields", F.lit(i)) for i in range(3))
    return rows.select(
        "dataset_id",
        number.cast("bigint").alias("doc_id"),
        F.md5(text).alias("text_md5"),
        F.length(text).alias("n_chars"),
        lang.alias("lang"),
        F.shiftright("row_idx", 20).alias("place"),
    )


def tracking_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking files with comments and a column ``valid``, read back as samples."""
    run = F.expr(f"event_id div {RUN_EVENTS}")
    place = F.col("event_id") % RUN_EVENTS + 1
    k = F.get_json_object("props", "$.k")
    data = F.concat_ws(
        ",",
        event_seconds().cast("string"),
        F.col("value").cast("string"),
        k,
        F.when(F.col("event_type") == "error", "0").otherwise("1"),
    )
    note = F.when(F.col("event_type") == "view", F.concat(data, F.lit(" # gesehen"))).otherwise(data)
    row = F.struct((place + 1).alias("row_idx"), note.alias("line"))
    head = F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.lit("# Kamera 1").alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.lit(" Zeit, X_pos ,y,Valid").alias("line")),
        row,
    )
    lines = table(spark, sf_dir, "events").select(
        run.alias("dataset_id"), F.explode(F.when(place == 1, head).otherwise(F.array(row))).alias("l")
    ).select("dataset_id", "l.*")
    _, rows = tracking.read_tracking(lines)
    return role_ops.tracking_samples(rows).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("t"), 3).alias("sum_t"),
        F.round(F.sum("x"), 3).alias("sum_x"),
        F.sum("y").alias("sum_y"),
        F.count("area").alias("n_area"),
    )


def role_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = delimited.detect(_lines(spark, sf_dir))
    return role_ops.role_table(delimited.accepted(layouts))


def angular_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_fit(physics.angular_regression(role_ops.pairs(_rows(spark, sf_dir), "time", "angle")))


def _rounded_fit(fit: DataFrame) -> DataFrame:
    return fit.select(
        "dataset_id",
        "n",
        F.round("slope", 9).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r_value", 7).alias("r_value"),
        F.round("r_squared", 7).alias("r_squared"),
        F.round("p_value", 5).alias("p_value"),
        F.round("slope_stderr", 9).alias("stderr"),
    )


def resonance_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = physics.resonance_points(
        role_ops.pairs(_rows(spark, sf_dir), "frequency", "spacing", positive=True)
    )
    return points.select(
        "dataset_id",
        "row_idx",
        "frequency_hz",
        "peak_spacing_m",
        F.round("wavelength_m", 6).alias("wavelength_m"),
        F.round("sound_speed_m_s", 6).alias("sound_speed_m_s"),
        F.round("inverse_frequency_s", 9).alias("inverse_frequency_s"),
    )


def _lineitem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity as frequency, discount as spacing, by line status; positive pairs only."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("dataset_id"),
        F.col("l_orderkey").alias("row_idx"),
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"),
    ).filter("x > 0 and y > 0")


def resonance_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tube = physics.resonance_summary(physics.resonance_points(_lineitem_pairs(spark, sf_dir)))
    return tube.select(
        "dataset_id",
        "n",
        *[
            F.round(f"speed_{c}", 6).alias(f"speed_{c}")
            for c in ("mean", "sample_std", "sem", "min", "max")
        ],
    )


def inverse_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    tube = physics.resonance_summary(physics.resonance_points(_lineitem_pairs(spark, sf_dir)))
    names = [
        "slope",
        "intercept",
        "slope_stderr",
        "intercept_stderr",
        "c_regression_m_s",
        "c_regression_stderr_m_s",
        "r_squared",
    ]
    return tube.select("dataset_id", "n", *[F.round(c, 9).alias(c) for c in names])


def latitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude of each run from its metadata and fitted slope."""
    fit = physics.angular_regression(role_ops.pairs(_rows(spark, sf_dir), "time", "angle"))
    result = physics.latitude_from_rate(fit, run_metadata(table(spark, sf_dir, "events")))
    return result.select(
        "dataset_id",
        "not_computable",
        "reason",
        F.round("omega_mess_rad_s", 9).alias("omega_mess_rad_s"),
        F.round("latitude_deg", 4).alias("latitude_deg"),
        "correction_factor_used",
    )


def latitude_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude with uncertainty; the rate is the fitted change of ``value`` per user, scaled."""
    fit = linear_fit(_traces(spark, sf_dir, "user_id"), ["user_id"], "t", "x")
    scale = 150_000.0
    rates = fit.filter("slope is not null").select(
        "user_id", (F.col("slope") * scale).alias("rate"), (F.col("slope_stderr") * scale).alias("error")
    )
    out = rates.withColumns(physics.latitude_with_error(F.col("rate"), F.col("error")))
    digits = {"sin_phi": 6, "phi_exp": 5, "delta_phi_ref": 5, "delta_phi_deg": 4, "abw_deg": 5, "abw_sigma": 3}
    return out.select(
        "user_id",
        *[F.round(c, d).alias(c) for c, d in digits.items()],
        F.col("hinweis_phi").isNotNull().alias("outside"),
    )


def error_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined, frequency, angular frequency and length errors of every order's numbers."""
    period, error = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(propagation.combined_error(F.col("l_discount"), F.col("l_tax")), 9).alias("combined"),
        F.round(propagation.combined_error(error, F.col("l_tax"), period), 7).alias("combined3"),
        F.round(propagation.frequency_error(period, error), 9).alias("frequency_error"),
        F.round(propagation.angular_frequency_error(period, error), 9).alias("omega_error"),
        F.round(propagation.pendulum_length(period), 6).alias("length_m"),
        F.round(propagation.pendulum_length_error(period, error), 8).alias("length_error"),
        F.round(propagation.per_second_to_per_hour(error), 4).alias("per_hour"),
        F.round(propagation.seconds_to_minutes(period), 8).alias("minutes"),
    )


# ── pendulum traces ──────────────────────────────────────────────────────────────────────────────


def successive_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = p.successive_difference(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return steps.select("user_id", "row_idx", F.round("dt", 6).alias("dt"))


def sampling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.sampling_summary(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return out.select(
        "user_id",
        "n",
        F.round("dt_s", 8).alias("dt_s"),
        F.round("fs_hz", 9).alias("fs_hz"),
        F.round("duration_s", 4).alias("duration_s"),
        F.round("duration_min", 4).alias("duration_min"),
    )


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.channel_stats(_traces(spark, sf_dir, "event_type"), ["event_type"])
    return out.select(
        "event_type",
        "channel",
        "n",
        *[F.round(c, 3).alias(c) for c in ("mean", "sample_std", "sem", "min", "max")],
    )


def trajectory_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.trajectory_extent(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return out.select(
        "user_id", *[F.round(c, 9).alias(c) for c in ("x_mean", "y_mean", "ax", "ay", "ellipticity")]
    )


def tracking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.tracking_quality(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in ("area_mean", "area_s", "area_cv")])


def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.zero_crossings(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return out.select("user_id", "row_idx", F.round("t_cross", 3).alias("t_cross"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.periods(_traces(spark, sf_dir, "user_id"), ["user_id"])
    return out.select("user_id", "row_idx", F.round("period", 3).alias("period"))


def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.period_stats(p.periods(_traces(spark, sf_dir, "user_id"), ["user_id"]), ["user_id"])
    digits = {
        "period_s": 3,
        "period_std_s": 3,
        "period_error_s": 3,
        "frequency_hz": 10,
        "frequency_error_hz": 10,
        "omega0": 10,
        "omega0_error": 10,
        "length_m": 0,
        "length_error_m": 0,
    }
    return out.select("user_id", "n_periods", *[F.round(c, d).alias(c) for c, d in digits.items()])


def period_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace_periods = cut_lineage(p.periods(_traces(spark, sf_dir, "event_type"), ["event_type"]))
    out = p.period_histogram(trace_periods, ["event_type"])
    return out.select("event_type", "bin", F.round("bin_start", 3).alias("bin_start"), "n")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.segment_axis(_traces(spark, sf_dir, "event_type"), ["event_type"])


def segment_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select(
        "event_type", "seg", "seg_rows", F.round("t_mid", 4).alias("t_mid"), F.round("phi", 6).alias("phi")
    )


def segment_axis_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = p.segment_axis(_traces(spark, sf_dir, "event_type"), ["event_type"], consistent=True)
    return segments.select("event_type", "seg", F.round("phi", 6).alias("phi"))


def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.unwrap_angles(_segments(spark, sf_dir), ["event_type"])
    return out.select("event_type", "seg", F.round("phi", 6).alias("phi"))


def plane_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.rotation_fit(p.unwrap_angles(_segments(spark, sf_dir), ["event_type"]), ["event_type"])
    digits = {
        "phi0_deg": 5,
        "phi0_error": 5,
        "b_deg_s": 10,
        "b_error": 10,
        "b_h": 6,
        "b_h_error": 6,
        "r2": 7,
        "s_y": 5,
        "sin_phi": 7,
        "phi_exp": 5,
        "abw_deg": 5,
    }
    return out.select("event_type", "n_seg", "seg_rows", *[F.round(c, d).alias(c) for c, d in digits.items()])


def rotation_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_lineage(p.unwrap_angles(_segments(spark, sf_dir), ["event_type"]))
    out = p.rotation_residuals(segments, p.rotation_fit(segments, ["event_type"]), ["event_type"])
    return out.select("event_type", "seg", F.round("residual", 5).alias("residual"))


def coordinate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_lineage(p.unwrap_angles(_segments(spark, sf_dir), ["event_type"]))
    return p.coordinate_export(segments, p.rotation_fit(segments, ["event_type"]), ["event_type"])


def slice_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p.slice_angles(_traces(spark, sf_dir, "event_type"), ["event_type"], seconds=86_400.0)
    return out.select("event_type", "slice", "n", F.round("alpha_deg", 6).alias("alpha_deg"))


_HELD_BACK = 10


def _arrived_slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """All samples as they were delivered in three parts, and the folder of their slices.

    The second half of the time comes after the first, and every tenth event of the first quarter comes last.
    """
    root = _new_folder(spark, "slices")
    samples = traces(table(spark, sf_dir, "events"), "event_type").select("event_type", "row_idx", "t", "x", "y")
    first, last = samples.agg(F.min("t"), F.max("t")).first()
    early = F.col("t") < first + (last - first) / 4
    held = early & (F.col("row_idx") % _HELD_BACK == 0)
    half = F.col("t") < (first + last) / 2
    for part in (half & ~held, ~half, held):
        samples.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(samples.schema).parquet(f"{root}/in")
        slice_arrivals(stream, f"{root}/out", f"{root}/progress", ["event_type"], 86_400.0, "2 days").awaitTermination()
    return spark.read.schema(samples.schema).parquet(f"{root}/in"), f"{root}/out"


def arriving_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of daily slices from samples that arrive in parts, without those that come too late."""
    _, out = _arrived_slices(spark, sf_dir)
    return read_slices(spark, out, ["event_type"]).select("event_type", "slice", "n", F.round("alpha_deg", 6).alias("alpha_deg"))


def late_slice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of samples of each daily slice that came too late."""
    return late_samples(*_arrived_slices(spark, sf_dir), ["event_type"], 86_400.0)


def pendulum_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete evaluation of every trace, as JSON with selected fields read back."""
    run = evaluate_traces(_traces(spark, sf_dir, "event_type"), ["event_type"])
    paths = {"n": "sampling.n", "n_periods": "periods.n_periods", "n_seg": "rotation.n_seg"}
    return run.results.select(
        "event_type",
        "title",
        *[F.get_json_object("results", f"$.{path}").cast("bigint").alias(c) for c, path in paths.items()],
    )


# ── catalog ──────────────────────────────────────────────────────────────────────────────────────


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_taxa(_catalog(spark, sf_dir)[0], "  _ED r", include_stubs=True)


def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalog(spark, sf_dir)[0]
    return catalog.search_envelope(found, "ring").unionByName(
        catalog.search_envelope(found, "ring", include_stubs=True)
    )


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = catalog.batch_search(_catalog(spark, sf_dir)[0], SEARCHES)
    return hits.select("query", "position", "taxon_id", "scientific_name", "status")


def search_texts(part: DataFrame) -> DataFrame:
    """Search texts made of the catalog's own names: pieces of names, with wildcards, ids, brands and wildcards alone."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 6
    piece = F.substr(name, F.lit(2), (F.col("p_size") % 7 + 1).cast("int"))
    return part.select(
        F.when(kind == 0, F.upper(piece))
        .when(kind == 1, F.replace(piece, F.lit("e"), F.lit("_")))
        .when(kind == 2, F.concat(F.lit(" "), F.substr(name, F.lit(1), F.lit(2)), F.lit("%"), F.substr(name, F.lit(-3), F.lit(3))))
        .when(kind == 3, F.col("p_partkey").cast("string"))
        .when(kind == 4, F.lower("p_brand"))
        .otherwise(F.repeat(F.lit("_"), (F.col("p_size") % 20).cast("int")))
        .alias("query")
    )


def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = catalog.search_table(_catalog(spark, sf_dir)[0], search_texts(table(spark, sf_dir, "part")))
    return hits.select("query", "position", "taxon_id", "scientific_name", "status")


def find_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_taxon(_catalog(spark, sf_dir)[0], " 17 ")


def taxon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_labels(_catalog(spark, sf_dir)[0]).select("taxon_id", "status_label", "source_label")


def photo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, owned = _catalog(spark, sf_dir)
    return catalog.first_photo_features(catalog.photo_features(owned, known)).select(
        "feature_id", "taxon_id", "organ", "character", "scientific_name", "german_name", "rank"
    )


def feature_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, owned = _catalog(spark, sf_dir)
    photo = catalog.photo_features(owned, known, "medium", "medium")
    return catalog.feature_text_filter(photo, " RING Brand#1 ").select(
        "feature_id", "taxon_id", "scientific_name", "german_name"
    )


_DETAIL = ["taxon_id", "scientific_name", "features_count", "position", "feature_id", *"organ feature_group character state diagnostic_weight".split()]


def taxon_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ranked_details(catalog.taxon_details(*_catalog(spark, sf_dir))).select(*_DETAIL)


def hot_taxon_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as features of their return flag: a few taxa with most of the rows, ranked in pieces."""
    owned = features(table(spark, sf_dir, "lineitem")).withColumn("taxon_id", F.col("organ"))
    flags = owned.select("taxon_id").distinct().withColumn("scientific_name", F.concat(F.lit("flag "), "taxon_id"))
    return catalog.ranked_details(catalog.taxon_details(flags, owned), 5000).select(*_DETAIL)


def active_without_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, owned = _catalog(spark, sf_dir)
    strong = owned.filter("diagnostic_weight = 'high' and visibility_in_photo = 'high'")
    return quality.active_without_features(known, strong).select("taxon_id", "rank", "status")


def dangling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dangling_features(*_catalog(spark, sf_dir))


def catalog_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    release = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("version"), F.nullif("r_name", F.lit("ASIA")).alias("release_stage")
    )
    return quality.catalog_expectations(_catalog(spark, sf_dir)[0], release, "ring", ["3", "5"])


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _catalog(spark, sf_dir)[0]
    return quality.completeness(known, ["status", "rank"], ["family", "app_scope", "german_name"])


def scope_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scope_tags(_catalog(spark, sf_dir)[0])


# ── protocol texts ───────────────────────────────────────────────────────────────────────────────


def forbidden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [*documents.FORBIDDEN_TERMS, *EXTRA_TERMS]
    return documents.forbidden_terms(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of text and bibliography rules per language, rule and severity."""
    tex, _ = _protocols(spark, sf_dir)
    found = documents.violations(tex, rules=[*documents.TEXT_RULES, *EXTRA_RULES], keep=["lang"])
    return found.groupBy("lang", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def rule_table(benchmark: DataFrame) -> DataFrame:
    """A rule for each longer word of the benchmark; every second one must stand as a whole word."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("literal")
    whole = F.concat(F.lit("(^|[^a-z])"), "literal", F.lit("([^a-z]|$)"))
    odd = F.length("literal") % 2 == 1
    return benchmark.select(words).distinct().select(
        F.col("literal").alias("rule_id"),
        "literal",
        F.when(odd, whole).alias("pattern"),
        F.when(odd, "error").otherwise("warning").alias("severity"),
        F.lit("Benchmark").alias("message"),
    )


def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are a table, one for each longer word of the benchmark, on all documents."""
    rules = rule_table(table(spark, sf_dir, "benchmark"))
    found = rule_findings(table(spark, sf_dir, "documents"), rules, "doc_id", "text", ["lang"])
    return found.groupBy("lang", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.citation_violations(*_protocols(spark, sf_dir)).select(
        "doc_id", "rule_id", "severity", F.col("detail").alias("key")
    )


def uncited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tex, bib = _protocols(spark, sf_dir)
    return documents.uncited_entries(documents.citations(tex), bib)


def bibliography_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read from bibliography files, one a source, whose values hold whole texts, braces and what looks like entries."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    entry = F.concat(
        F.when(F.col("doc_id") % 3 == 0, "@comment{ @misc{none} }\n").otherwise("text outside @ of entries\n"),
        F.lit("@Article {\n  key"),
        number,
        F.lit(",\n  title = {"),
        F.translate("text", "{}", "()"),
        F.lit(" @misc{inner"),
        number,
        F.lit(', y = {}}},\n  note = "@book{quoted, z}"\n}\n'),
    )
    root = _new_folder(spark, "literature")
    docs.select("source", entry.alias("entry")).repartition("source").write.partitionBy("source").text(root)
    found = read_bibliographies(spark, f"{root}/*", block_rows=1 << 16)
    return found.select(F.regexp_extract("doc_id", "source=([^/]+)$", 1).alias("source"), "entry_type", "key")


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tex, bib = _protocols(spark, sf_dir)
    return documents.quality_report(tex, bib, [*documents.TEXT_RULES, *EXTRA_RULES])


def _tokens(df: DataFrame, id_column: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    return df.select(id_column, F.explode(words).alias("key"))


def citations_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that no benchmark text contains, with the number of documents."""
    cited = _tokens(table(spark, sf_dir, "documents"), "doc_id")
    known = _tokens(table(spark, sf_dir, "benchmark"), "item_id")
    return documents.missing_citations(cited, known, per_document=False)


def fence_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    wrapped = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```LaTeX\n"), text, F.lit("\n```\n")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Hier: \\documentclass{article}\n"), text, F.lit(" ")))
        .otherwise(F.concat(F.lit("``` "), text))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", clean_generated_text(wrapped).alias("text")
    )


# ── payloads and reports ─────────────────────────────────────────────────────────────────────────


def payload_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = typed_payloads(table(spark, sf_dir, "events"))
    kind = df.schema["payload"].dataType
    return df.select("event_id", F.to_json(payload.scrub(F.col("payload"), kind)).alias("payload"))


def payload_scrub_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads as text of unknown schema, nulls written out."""
    df = typed_payloads(table(spark, sf_dir, "events"))
    text = F.to_json("payload", {"ignoreNullFields": "false"})
    clean = payload.scrub_open(df.select("event_id", text.alias("payload")), "payload", "c")
    return clean.select("event_id", F.col("c.json").alias("payload"), F.size("c.warnings").alias("n_warnings"))


def scrub_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = typed_payloads(table(spark, sf_dir, "events"))
    return payload.audit(df, "event_id", F.col("payload"), df.schema["payload"].dataType)


def generation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from documents: preferred fields, plain messages or neither."""
    kind = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(kind == 0, F.lit("Kurz.")).alias("system"),
        F.when(kind == 2, F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("csv")))))
        .otherwise(none)
        .alias("messages"),
        F.when(kind < 2, F.col("source")).alias("experiment_title"),
        none.alias("experiment_type"),
        F.when(kind == 1, F.col("text")).alias("lab_notes"),
        F.when(kind == 1, F.lit('{"file_content": "x", "mass": 5}')).otherwise(F.lit("{}")).alias("metadata"),
        none.alias("summary_for_generation"),
        F.lit("[]").alias("selected_analysis_blocks"),
        none.alias("generation_rules"),
        F.when(F.col("lang") == "de", F.col("text")).alias("raw_csv"),
        none.alias("csv"),
        none.alias("file_content"),
    )
    built = payload.assemble_payloads(requests)
    return built.select(
        "request_id",
        "kind",
        (F.col("system") == "Kurz.").alias("own_system"),
        F.get_json_object("payload", "$.experiment_title").alias("title"),
        F.get_json_object("payload", "$.lab_notes").alias("notes"),
        F.get_json_object("payload", "$.metadata.mass").alias("mass"),
        F.array_join("warnings", "|").alias("warnings"),
        "error",
    )


def selected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of the blocks chosen from each file's analysis: overview, error formula and all warnings."""
    result = _analysis(spark, sf_dir)
    blocks = result.preview_blocks.filter(
        "id in ('dataset_overview', 'gaussian_error_template') or source.array = 'warnings'"
    )
    selection = blocks.select(F.concat(F.lit("r"), F.col("dataset_id").cast("string")).alias("request_id"), "dataset_id", "id")
    none = F.lit(None).cast("string")
    names = ["system", "messages", *payload.PREFERRED_FIELDS, *payload.RAW_KEYS]
    requests = result.layouts.select(F.concat(F.lit("r"), F.col("dataset_id").cast("string")).alias("request_id"), *[none.alias(n) for n in names])
    requests = requests.withColumn("experiment_title", F.concat(F.lit("Versuch "), "request_id"))
    built = payload.assemble_payloads(payload.with_selected_blocks(requests, blocks, selection))
    return built.select("request_id", "kind", "payload", F.size("warnings").alias("n_warnings"))


def preview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _analysis(spark, sf_dir).preview_blocks
    return blocks.select(
        "dataset_id",
        F.col("block").cast("bigint"),
        "id",
        "type",
        "section",
        F.col("source.array").alias("source_array"),
    )


def selected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of blocks and of preselected blocks per file and section."""
    blocks = cut_lineage(_analysis(spark, sf_dir).preview_blocks)
    chosen = report.select_blocks(blocks, report.default_selection(blocks))
    return chosen.groupBy("dataset_id", "section").agg(F.count(F.lit(1)).alias("n_selected"))


def analysis_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).warnings.select("dataset_id", "id", "title")


def generation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, names = _cells(spark, sf_dir)
    overview = profile.dataset_overview(profile.counts_per_column(cells), names)
    return report.generation_summary(overview)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _item_details(item_id: Column, data: Column) -> Column:
    """What an item says, as text: exact numbers where there are any, else the names of its members."""
    statistics = F.from_json(data, "array<struct<column:string,n:bigint,min:double,max:double>>")
    columns = F.from_json(data, "array<struct<column:string,inferred_type:string,missing_count:bigint,unique_count:bigint,is_constant:boolean>>")
    listed = F.transform(statistics, lambda r: F.format_string("%s:%d:%.3f:%.3f", r["column"], r["n"], r["min"], r["max"]))
    kinds = F.transform(
        columns,
        lambda r: F.format_string("%s:%s:%d:%d:%s", r["column"], r["inferred_type"], r["missing_count"], r["unique_count"], r["is_constant"]),
    )
    rows = F.coalesce(F.get_json_object(data, "$.rows"), F.get_json_object(data, "$.coordinates.rows"))
    table = F.coalesce(F.get_json_object(data, "$.table"), F.get_json_object(data, "$.coordinates.table"))
    size = F.concat_ws(":", F.get_json_object(data, "$.rows"), F.get_json_object(data, "$.columns"), F.get_json_object(data, "$.missing_values"))
    return (
        F.when(item_id == "raw_statistics", F.array_join(listed, " "))
        .when(item_id == "column_profile", F.array_join(kinds, " "))
        .when(item_id == "dataset_overview", size)
        .when(item_id == "missing_values_summary", F.get_json_object(data, "$.total_missing_values"))
        .when(table.isNotNull(), F.concat_ws(":", table, rows))
        .otherwise(F.array_join(F.json_object_keys(data), ","))
    )


def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports written as JSON and read back: every item of their five arrays, with the block made of it."""
    root = _new_folder(spark, "analysis")
    _analysis(spark, sf_dir).write(root, "json", ["reports"])
    reports = spark.read.schema("dataset_id long, report string").json(f"{root}/reports")
    arrays = F.array(*[F.struct(F.lit(n).alias("source_array"), F.get_json_object("report", f"$.{n}").alias("items")) for n in report.SECTIONS])
    raw = F.from_json("a.items", "array<variant>")
    each = reports.select(
        "dataset_id",
        F.get_json_object("report", "$.row_count").cast("bigint").alias("row_count"),
        F.get_json_object("report", "$.column_count").cast("bigint").alias("column_count"),
        F.from_json(F.get_json_object("report", "$.preview_blocks"), "array<struct<id:string,content:struct<data:string>>>").alias("blocks"),
        F.explode(arrays).alias("a"),
    ).select("*", F.posexplode(raw).alias("position", "item"))
    item = F.to_json("item")
    data, name = F.get_json_object(item, "$.data"), F.get_json_object(item, "$.id")
    own = F.filter("blocks", lambda b: b["id"] == name)
    return each.select(
        "dataset_id",
        "row_count",
        "column_count",
        "a.source_array",
        "position",
        name.alias("id"),
        F.get_json_object(item, "$.title").alias("title"),
        _item_details(name, F.element_at(own, 1)["content"]["data"]).alias("details"),
        (F.size(F.json_object_keys(item)) == 8).alias("whole"),
        data.isNotNull().alias("has_data"),
    )


def written_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the resonance tubes, written in blocks and read back in the order of their file."""
    root = _new_folder(spark, "analysis")
    _analysis(spark, sf_dir).write(root, "json", ["resonance_points"])
    columns = "frequency_hz peak_spacing_m wavelength_m sound_speed_m_s inverse_frequency_s".split()
    schema = ", ".join(["dataset_id long, row_idx long", *(f"{c} double" for c in columns)])
    read = read_ordered(spark, f"{root}/resonance_points", schema, fmt="json")
    return read.select("dataset_id", "position", "row_idx", "frequency_hz", "peak_spacing_m", F.round("wavelength_m", 6).alias("wavelength_m"))


def written_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates of both plots of every file as text, written and read back chunk by chunk."""
    root = _new_folder(spark, "analysis")
    tables = ["tube_coordinates", "angle_coordinates"]
    _analysis(spark, sf_dir).write(root, "json", tables)
    schema = "dataset_id long, chunk long, n long, offset long, coordinates string"
    read = [spark.read.schema(schema).json(f"{root}/{t}").withColumn("plot", F.lit(t)) for t in tables]
    return read[0].unionByName(read[1])


def arrival_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement files analysed by the streaming query, read from the table it wrote."""
    root = _new_folder(spark, "arrival")
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", (1 << 31) - 1)  # runs may cross files, so all files are one batch
        .parquet(sf_dir)
    )
    query = analyse_arrivals(
        measurement_lines(stream), f"{root}/out", f"{root}/progress", lambda lines: {"statistics": analyse(lines).statistics}
    )
    query.awaitTermination()
    return read_arrivals(spark, f"{root}/out", "statistics").select(
        "dataset_id", "column", "n", _mean_digits(F.col("mean")).alias("mean"), "min", "max"
    )


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """The measurement files of the events as text files, one folder each, below the checkpoint folder."""
    root = _new_folder(spark, "landing")
    ordered = _lines(spark, sf_dir).repartition("dataset_id").sortWithinPartitions("dataset_id", "row_idx")
    ordered.select("dataset_id", "line").write.partitionBy("dataset_id").text(root)
    return root


def _run_number(path: Column) -> Column:
    return F.regexp_extract(path, "dataset_id=([0-9]+)", 1).cast("bigint")


def arrival_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a landing folder streamed in several batches with the whole analysis; the fits it wrote."""
    root = _new_folder(spark, "arrival")
    lines = stream_files(spark, f"{_landed(spark, sf_dir)}/*", 300, _run_number)
    analyse_arrivals(lines, f"{root}/out", f"{root}/progress").awaitTermination()
    return _rounded_fit(read_arrivals(spark, f"{root}/out", "regression"))


def read_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters of the measurement files, read from files with numbered lines."""
    lines = read_text_lines(spark, f"{_landed(spark, sf_dir)}/*").withColumn("dataset_id", _run_number(F.col("dataset_id")))
    return lines.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
        F.min_by("line", "row_idx").alias("header"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        linear_regression,
        regression_pvalue,
        numeric_stats,
        file_stats,
        column_profile,
        missing_summary,
        dataset_overview,
        numeric_normalise,
        read_lines,
        delimiter_detect,
        parse_cells,
        hard_files,
        multiline_cells,
        tracking_read,
        role_binding,
        angular_regression,
        resonance_points,
        resonance_speed,
        inverse_regression,
        latitude,
        latitude_error,
        error_propagation,
        successive_difference,
        sampling_summary,
        channel_stats,
        trajectory_extent,
        tracking_quality,
        zero_crossings,
        periods,
        period_stats,
        period_histogram,
        segment_axis,
        segment_axis_consistent,
        angle_unwrap,
        plane_rotation,
        rotation_residuals,
        coordinate_export,
        slice_angles,
        arriving_slices,
        late_slice_samples,
        pendulum_results,
        catalog_search,
        search_envelope,
        batch_search,
        table_search,
        find_taxon,
        taxon_labels,
        photo_features,
        feature_text_filter,
        taxon_detail,
        hot_taxon_detail,
        active_without_features,
        dangling_features,
        catalog_expectations,
        completeness,
        scope_tags,
        forbidden_terms,
        text_rules,
        table_rules,
        citation_rules,
        uncited_entries,
        bibliography_files,
        doc_quality,
        citations_missing,
        fence_clean,
        payload_scrub,
        payload_scrub_open,
        scrub_audit,
        generation_payloads,
        selected_payloads,
        preview_blocks,
        selected_blocks,
        analysis_warnings,
        generation_summaries,
        analysis_reports,
        written_points,
        written_coordinates,
        arrival_statistics,
        arrival_regression,
        read_file_lines,
    )
}
