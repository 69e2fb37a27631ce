"""Report items, warnings, preview blocks and the sinks of an analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.functions.text import contains_any
from labspark.operators.documents import FORBIDDEN_TERMS

# Report sections by array name, in report order.
SECTIONS = {
    "tables": "Tabellen",
    "figures": "Abbildungen",
    "results": "Messergebnisse",
    "calculations": "Rechnungen",
    "warnings": "Warnungen",
}
# Id -> (array, place in the array, title, description, shown by default, essential, hint).
ITEMS = {
    "raw_statistics": (
        "tables",
        1,
        "Statistik der Messspalten",
        "Zeilenanzahl, Mittelwert, Stichprobenstandardabweichung, SEM, Minimum und Maximum für alle numerischen Spalten.",
        True,
        False,
        "",
    ),
    "column_profile": (
        "tables",
        2,
        "Spaltenprofil",
        "Erkannter Spaltentyp, fehlende Werte, numerische Werte, Textwerte und Konstantheit je Spalte.",
        False,
        False,
        "",
    ),
    "rubensrohr_sound_speed_table": (
        "tables",
        3,
        "Rubensrohr-Schallgeschwindigkeit je Messpunkt",
        "Wellenlänge und Schallgeschwindigkeit aus Frequenz und Maxima-Abstand.",
        True,
        False,
        "Tabelle mit frequency_Hz, peak_spacing_m, wavelength_m und sound_speed_m_s.",
    ),
    "rubensrohr_inverse_frequency_plot": (
        "figures",
        1,
        "Rubensrohr: Abstand gegen inverse Frequenz",
        "Pgfplots-kompatible Koordinaten für peak_spacing_m gegen 1/frequency_Hz.",
        True,
        False,
        "",
    ),
    "angle_time_plot": (
        "figures",
        2,
        "Winkel-Zeit-Diagramm",
        "Pgfplots-kompatible Koordinaten der ausgewerteten Zeit- und Winkelwerte mit Regressionsgerade.",
        True,
        False,
        "",
    ),
    "missing_values_summary": (
        "results",
        1,
        "Fehlende Werte",
        "Gesamtzahl und Verteilung fehlender Werte pro Spalte.",
        True,
        False,
        "",
    ),
    "dataset_overview": (
        "results",
        2,
        "Datenbasis",
        "Die Rohdaten wurden vollständig eingelesen und tabellarisch ausgewertet.",
        True,
        True,
        "",
    ),
    "rubensrohr_sound_speed_result": (
        "results",
        3,
        "Rubensrohr-Schallgeschwindigkeit",
        "Mittelwert, Stichprobenstandardabweichung und SEM der berechneten Schallgeschwindigkeit.",
        True,
        True,
        "",
    ),
    "latitude_result": (
        "results",
        4,
        "Breitengrad aus Winkelgeschwindigkeit",
        "Berechnung nur bei explizit definierter Winkelgeschwindigkeit oder Winkeleinheit möglich.",
        True,
        False,
        "",
    ),
    "rubensrohr_inverse_frequency_regression": (
        "calculations",
        1,
        "Rubensrohr-Regression über inverse Frequenz",
        "Linearer Fit von peak_spacing_m gegen 1/frequency_Hz; c_regression = 2 * slope.",
        True,
        True,
        "",
    ),
    "angular_regression": (
        "calculations",
        2,
        "Lineare Winkelregression",
        "Deterministische lineare Regression für erkannte Zeit-Winkel-Paare mit Slope, Intercept, R² und p-Wert.",
        True,
        False,
        "",
    ),
    "gaussian_error_template": (
        "calculations",
        3,
        "Symbolische Fehlerfortpflanzung",
        "Allgemeines Sympy-Beispiel für quadratische Gaußsche Fehlerfortpflanzung mit Sympy-LaTeX-Export.",
        True,
        False,
        "",
    ),
}
# Warnings about one column, by kind: (title, description).
COLUMN_WARNINGS = {
    "empty_column": ("Leere Spalte", "Diese Spalte enthält keine auswertbaren Werte."),
    "mixed_column": (
        "Gemischte Spalte",
        "Diese Spalte enthält sowohl numerische als auch textuelle Werte.",
    ),
    "constant_numeric_column": (
        "Konstante numerische Spalte",
        "Diese numerische Spalte besitzt keine Variation.",
    ),
}
# Warnings about a dataset: id -> (place, title, description, needs a to-do).
DATASET_WARNINGS = {
    "rubensrohr_insufficient_data": (
        2,
        "Rubensrohr-Auswertung nicht möglich",
        "Frequenz- und Abstandsspalten wurden erkannt, aber weniger als zwei positive Wertepaare sind vorhanden.",
        False,
    ),
    "rubensrohr_no_variation": (
        3,
        "Rubensrohr-Regression nicht möglich",
        "Alle Frequenzen sind gleich; die Regression besitzt keine Variation.",
        False,
    ),
    "no_time_angle_regression": (
        4,
        "Keine Zeit-Winkel-Regression",
        "Es wurden keine eindeutig benannten Zeit- und Winkelspalten gefunden oder die unabhängige Variable besitzt keine Variation.",
        True,
    ),
    "xy_tracking_no_angle": (
        5,
        "x/y-Tracking ohne definierte Winkeltransformation",
        "Aus x/y-Spuren wurde kein physikalischer Winkel berechnet; eine explizite Transformation ist erforderlich.",
        True,
    ),
    "ambiguous_physical_interpretation": (
        7,
        "Keine physikalische Spezialauswertung",
        "Die Datei wurde statistisch profiliert; ohne bekannten Spaltensatz wird keine physikalische Interpretation vorgenommen.",
        False,
    ),
}
# Parameters expected in the metadata.
EXPECTED_PARAMETERS = ["calibration", "pendulum_length", "frame_rate", "mass", "device_parameters"]
# Texts of rules and errors, and the formula of the error propagation.
SELECTED_ITEM_RULE = (
    "Only selected items from tables, figures, results, calculations listed here."
)
FORBIDDEN_ERROR = (
    "Interne Provenienzbegriffe dürfen nicht in summary_for_generation erscheinen."
)
ERROR_FORMULA = r"\sqrt{\Delta_{x}^{2} + \Delta_{y}^{2}}"

ITEM_COLUMNS = [
    "dataset_id",
    "source_array",
    "ord",
    "id",
    "type",
    "title",
    "description",
    "include_default",
    "essential",
    "data",
    "latex_hint",
]


def json_text(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def item(df: DataFrame, item_id: str, data: Column, include: Column | None = None) -> DataFrame:
    """One item per row of ``df``; texts come from the fixed table."""
    array, place, title, description, shown, essential, hint = ITEMS[item_id]
    return df.select(
        "dataset_id",
        F.lit(array).alias("source_array"),
        _ord(place).alias("ord"),
        F.lit(item_id).alias("id"),
        F.lit(array.rstrip("s")).alias("type"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
        (F.lit(shown) if include is None else include).alias("include_default"),
        F.lit(essential).alias("essential"),
        data.cast("string").alias("data"),
        F.lit(hint).alias("latex_hint"),
    )


def _ord(group: int, place: Column | None = None) -> Column:
    """Sort key of an item: its group, then its place, which is a 32-bit number and so never reaches the next group."""
    return F.lit(group << 32).cast("bigint") + (F.lit(0) if place is None else place)


def _warning(item_id: Column, ord_: Column, title: Column, description: Column, data: Column) -> list[Column]:
    return [
        F.lit("warnings").alias("source_array"),
        ord_.alias("ord"),
        item_id.alias("id"),
        F.lit("warning").alias("type"),
        title.alias("title"),
        description.alias("description"),
        F.lit(True).alias("include_default"),
        F.lit(False).alias("essential"),
        data.alias("data"),
        F.lit("").alias("latex_hint"),
    ]


def column_warnings(named_profile: DataFrame) -> DataFrame:
    """Warnings for empty, mixed and constant numeric columns; at most one per column."""
    kind = (
        F.when(F.col("inferred_type") == "empty", "empty_column")
        .when(F.col("inferred_type") == "mixed", "mixed_column")
        .when((F.col("inferred_type") == "numeric") & F.col("is_constant"), "constant_numeric_column")
    )
    texts = F.create_map(
        *[
            part
            for name, (title, description) in COLUMN_WARNINGS.items()
            for part in (
                F.lit(name),
                F.struct(F.lit(title).alias("title"), F.lit(description).alias("description")),
            )
        ]
    )
    found = named_profile.withColumn("_kind", kind).filter("_kind is not null").withColumn(
        "_text", F.element_at(texts, F.col("_kind"))
    )
    return found.select(
        "dataset_id",
        *_warning(
            F.concat_ws("_", "_kind", "column"),
            _ord(1, F.col("col_idx")),
            F.concat_ws(": ", "_text.title", "column"),
            F.col("_text.description"),
            json_text(F.struct("column")),
        ),
    )


def is_falsy(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("", "0", "0.0", "false", "False", "[]", "{}", "null")


def dataset_warnings(flags: DataFrame) -> DataFrame:
    """Warnings decided per dataset, as an array on the dataset's own row.

    ``flags(dataset_id, has_tube, tube_pairs, tube_fitted, has_regression, names_time_or_angle, has_xy,
    metadata)``.
    """
    tube, fit = F.col("has_tube"), F.col("has_regression")
    tracked = F.col("has_xy") & ~fit
    conditions = {
        "rubensrohr_insufficient_data": tube & (F.col("tube_pairs") < 2),
        "rubensrohr_no_variation": tube & (F.col("tube_pairs") >= 2) & ~F.col("tube_fitted"),
        "no_time_angle_regression": ~fit & F.col("names_time_or_angle"),
        "xy_tracking_no_angle": tracked,
        "ambiguous_physical_interpretation": ~(tube | fit | tracked),
    }
    raised = []
    for item_id, condition in conditions.items():
        place, title, description, todo = DATASET_WARNINGS[item_id]
        note = {"not_computable": True, "requires_todo": True} if todo else {"not_computable": True}
        data = "{" + ",".join(f'"{k}":true' for k in note) + "}"
        raised.append(
            F.when(
                condition,
                F.struct(
                    *_warning(
                        F.lit(item_id), _ord(place), F.lit(title), F.lit(description), F.lit(data)
                    )
                ),
            )
        )
    for i, name in enumerate(EXPECTED_PARAMETERS):
        absent = is_falsy(F.try_element_at("metadata", F.lit(name)))
        raised.append(
            F.when(
                (fit | F.col("has_xy")) & absent,
                F.struct(
                    *_warning(
                        F.lit(f"missing_{name}"),
                        _ord(6, F.lit(i)),
                        F.lit(f"Fehlender Parameter: {name}"),
                        F.lit(f"{name} wurde nicht in den Metadaten bereitgestellt."),
                        F.lit('{"not_computable":true}'),
                    )
                ),
            )
        )
    return flags.select("dataset_id", F.explode(F.array_compact(F.array(*raised))).alias("w")).select(
        "dataset_id", "w.*"
    )


def preview_blocks(items: DataFrame) -> DataFrame:
    """Items of the five arrays as blocks in section order.

    A block without id is named by its array and place, one without type by the array, one without
    title by its id.  A dataset has as many items as fixed kinds plus header columns.
    """
    section = F.create_map(*[F.lit(v) for pair in SECTIONS.items() for v in pair])
    ordinal = F.array_position(F.array(*[F.lit(name) for name in SECTIONS]), F.col("source_array"))
    order = Window.partitionBy("dataset_id").orderBy("section_ord", "ord", "id")
    placed = items.withColumn("section_ord", ordinal).withColumn("block", F.row_number().over(order))
    block_id = F.coalesce(
        F.nullif("id", F.lit("")), F.concat_ws("_", "source_array", F.col("block").cast("string"))
    )
    return placed.select(
        "dataset_id",
        "block",
        block_id.alias("id"),
        F.coalesce(
            F.nullif("type", F.lit("")), F.rtrim(F.col("source_array"), F.lit("s"))
        ).alias("type"),
        F.element_at(section, F.col("source_array")).alias("section"),
        F.coalesce(F.nullif("title", F.lit("")), block_id).alias("title"),
        F.struct(
            F.coalesce("description", F.lit("")).alias("description"),
            "data",
            F.coalesce("latex_hint", F.lit("")).alias("latex_hint"),
        ).alias("content"),
        F.struct(F.col("source_array").alias("array"), block_id.alias("id")).alias("source"),
        "include_default",
        "essential",
    )


def default_selection(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("include_default") | F.col("essential")).select("dataset_id", "id")


def select_blocks(blocks: DataFrame, selection: DataFrame) -> DataFrame:
    """Blocks named by ``selection(dataset_id, id)``."""
    return blocks.join(selection.select("dataset_id", "id"), ["dataset_id", "id"], "left_semi")


def selected_block_lists(blocks: DataFrame, selection: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """``keys, selected_analysis_blocks``: the chosen blocks as a JSON array in their order.

    ``selection`` has ``dataset_id``, ``id`` and the ``keys`` of the lists, as several lists may be chosen from one
    dataset.  A block chosen twice stands once; what names no block is ignored.
    """
    chosen = selection.select("dataset_id", "id", *[k for k in keys if k != "dataset_id"]).distinct()
    found = chosen.join(blocks, ["dataset_id", "id"]).select(*keys, F.struct("dataset_id", "block", _block_json().alias("json")).alias("e"))
    return found.groupBy(*keys).agg(_listed(F.collect_list("e")).alias("selected_analysis_blocks"))


def generation_summary(overview: DataFrame) -> DataFrame:
    """``dataset_id, summary, error``: the summary as JSON, or an error where it names a forbidden term."""
    summary = json_text(
        F.struct(
            F.lit(True).alias("used_all_rows"),
            "row_count",
            "column_count",
            "detected_numeric_columns",
            F.lit(SELECTED_ITEM_RULE).alias("selected_item_rule"),
        )
    )
    clean = F.size(contains_any(F.col("_summary"), FORBIDDEN_TERMS)) == 0
    return overview.select("dataset_id", summary.alias("_summary")).select(
        "dataset_id",
        F.when(clean, F.col("_summary")).alias("summary"),
        F.when(~clean, FORBIDDEN_ERROR).alias("error"),
    )


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _with_json(scalars: Column, name: str, value: Column) -> Column:
    """The JSON of a struct of scalars with one more member, whose value is JSON already."""
    text = json_text(scalars)
    return F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(f',"{name}":'), F.coalesce(value, F.lit("null")), F.lit("}"))


def item_json(df: DataFrame) -> DataFrame:
    """``dataset_id, source_array, ord, id, json`` of items: their members in fixed order, the data nested."""
    head = _with_json(F.struct("id", "type", "title", "description", "include_default", "essential"), "data", F.col("data"))
    hint = F.concat(F.lit(',"latex_hint":'), _quoted(F.coalesce("latex_hint", F.lit(""))), F.lit("}"))
    return df.select("dataset_id", "source_array", "ord", "id", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), hint).alias("json"))


def _block_json() -> Column:
    description = _with_json(F.struct(F.col("content.description").alias("description")), "data", F.col("content.data"))
    hint = F.concat(F.lit(',"latex_hint":'), _quoted(F.col("content.latex_hint")), F.lit("}"))
    content = F.concat(F.substr(description, F.lit(1), F.length(description) - 1), hint)
    head = _with_json(F.struct("id", "type", "section", "title"), "content", content)
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"source":'), json_text(F.col("source")), F.lit("}"))


def _listed(entries: Column) -> Column:
    """Sorted (order, JSON) entries as a JSON array."""
    texts = F.transform(F.array_sort(entries), lambda e: e["json"])
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def nested_report(overview: DataFrame, items: DataFrame, blocks: DataFrame, summary: DataFrame) -> DataFrame:
    """``dataset_id, report``: one JSON report per dataset with its five arrays of items and the blocks.

    Lists over rows stay in tables of their own, which the items name together with the number of rows.
    A dataset has as many items as fixed kinds plus header columns.
    """
    by_array = item_json(items).groupBy("dataset_id").agg(
        *[
            _listed(F.collect_list(F.when(F.col("source_array") == name, F.struct("ord", "id", "json")))).alias(name)
            for name in SECTIONS
        ]
    )
    listed = blocks.select("dataset_id", F.struct("block", _block_json().alias("json")).alias("e")).groupBy("dataset_id").agg(
        _listed(F.collect_list("e")).alias("preview_blocks")
    )
    joined = (
        overview.join(by_array, "dataset_id", "left")
        .join(listed, "dataset_id", "left")
        .join(summary.select("dataset_id", "summary"), "dataset_id", "left")
    )
    text = json_text(F.struct(F.lit(True).alias("used_all_rows"), "row_count", "column_count", "detected_numeric_columns"))
    parts = [F.substr(text, F.lit(1), F.length(text) - 1)]
    for name in SECTIONS:
        parts += [F.lit(f',"{name}":'), F.coalesce(name, F.lit("[]"))]
    parts += [F.lit(',"summary_for_generation":'), F.coalesce(_quoted(F.col("summary")), F.lit("null"))]
    parts += [F.lit(',"preview_blocks":'), F.coalesce("preview_blocks", F.lit("[]")), F.lit("}")]
    return joined.select("dataset_id", F.concat(*parts).alias("report"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
