"""The same results as plain SQL, to check every query on whole tables with another engine."""

from __future__ import annotations

import json

from labspark.operators.documents import FORBIDDEN_TERMS, TEXT_RULES
from labspark.operators.physics import REASON_DOMAIN, REASON_UNIT
from labspark.operators.report import (
    COLUMN_WARNINGS,
    DATASET_WARNINGS,
    ERROR_FORMULA,
    EXPECTED_PARAMETERS,
    ITEMS,
    SECTIONS,
    SELECTED_ITEM_RULE,
)
from labspark.plans.queries import EXTRA_RULES, EXTRA_TERMS, RUN_KINDS, SEARCHES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ── derived inputs ───────────────────────────────────────────────────────────────────────────────

_MEASURED = """
m AS (
  SELECT event_id // 200 AS dataset_id, (event_id // 200) % 6 AS kind, event_id % 200 + 1 AS row_idx, event_id,
         user_id, event_type, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS v,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, nullif(event_type, 'error') AS typ
  FROM events
)"""
_NAME_ROWS = ",\n".join(
    f"({kind}, {i}, {_quote(name)})"
    for kind, (delimiter, header) in enumerate(RUN_KINDS)
    for i, name in enumerate(header.split(delimiter))
)
_NAMES = f"names(kind, col_idx, \"column\") AS (VALUES {_NAME_ROWS})"
_CELLS = f"""
{_MEASURED},
{_NAMES},
raw_cells AS (
  SELECT dataset_id, kind, unnest([0, 1, 2, 3]) AS col_idx,
         unnest(CASE WHEN kind = 4 THEN [k, v, t, NULL] ELSE [t, v, k, NULL] END) AS num,
         unnest([NULL, NULL, NULL, typ]) AS txt
  FROM m
),
cells AS (SELECT c.*, n."column" FROM raw_cells c JOIN names n USING (kind, col_idx))
"""


def _fit(x: str, y: str, source: str, keys: str, where: str = "true") -> str:
    """Fit sums and results per group, as in the textbook."""
    return f"""
sums AS (
  SELECT {keys}, count(*) AS n, avg({x}) AS mx, avg({y}) AS my,
         var_pop({x}) * count(*) AS sxx, var_pop({y}) * count(*) AS syy, covar_pop({x}, {y}) * count(*) AS sxy
  FROM {source} WHERE ({where}) AND {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys}
),
fit AS (
  SELECT {keys}, n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept,
         CASE WHEN syy > 0 THEN sxy / sqrt(sxx * syy) ELSE 0 END AS r,
         CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) ELSE 0 END AS stderr,
         sxx, syy, mx, greatest(syy - sxy * sxy / sxx, 0) AS rss
  FROM sums WHERE n >= 2 AND sxx > 0
)"""


# Two-sided p-value of t for an integer number of degrees of freedom, by the finite trigonometric sum.
_P_VALUE = """
pv AS (
  SELECT *, atan(abs(r) * sqrt((n - 2) / greatest((1 - r) * (1 + r), 1e-300)) / sqrt(n - 2)) AS theta FROM fit
),
p AS (
  SELECT *, CASE
    WHEN (n - 2) % 2 = 0 THEN 1 - sin(theta) * list_sum(list_transform(range(0, (n - 2) // 2),
      lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1)) / sqrt(pi()) * pow(cos(theta), 2 * i)))
    ELSE 1 - 2 / pi() * (theta + sin(theta) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2),
      lambda i: sqrt(pi()) / 2 * exp(lgamma(i + 1) - lgamma(i + 1.5)) * pow(cos(theta), 2 * i + 1))), 0))
  END AS p_value FROM pv
)"""


def _traces(key: str) -> str:
    return f"""
s AS (
  SELECT {key}, event_id AS row_idx, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value + 80 AS area
  FROM events
)"""


_HELD = """
h AS (
  SELECT s.*, row_idx % 10 = 0 AND t < t0 + (t1 - t0) / 4 AS held FROM s, (SELECT min(t) AS t0, max(t) AS t1 FROM s)
)"""


def _crossings(key: str) -> str:
    return f"""
{_traces(key)},
c0 AS (
  SELECT *, x - avg(x) OVER (PARTITION BY {key}) AS xc FROM s
),
c1 AS (
  SELECT *, lead(xc) OVER w AS xn, lead(t) OVER w AS tn FROM c0 WINDOW w AS (PARTITION BY {key} ORDER BY row_idx)
),
crossings AS (
  SELECT {key}, row_idx, t - xc / (xn - xc) * (tn - t) AS t_cross FROM c1 WHERE xc < 0 AND xn >= 0
),
periods AS (
  SELECT * FROM (
    SELECT {key}, row_idx, t_cross - lag(t_cross) OVER (PARTITION BY {key} ORDER BY row_idx) AS period FROM crossings
  ) WHERE period IS NOT NULL
)"""


def _segments(covariance: str = "covar_pop") -> str:
    return f"""
{_traces("event_type")},
r AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY row_idx) - 1 AS rn,
         count(*) OVER (PARTITION BY event_type) // 30 AS size
  FROM s
),
segs AS (
  SELECT event_type, rn // size AS seg, size AS seg_rows,
         max(CASE WHEN rn % size = size // 2 THEN t END) AS t_mid,
         degrees(0.5 * atan2(2 * {covariance}(x, y), var_samp(x) - var_samp(y))) AS phi
  FROM r WHERE size > 0 AND rn // size < 30 GROUP BY ALL
),
turned AS (
  SELECT *, phi - lag(phi) OVER (PARTITION BY event_type ORDER BY seg) AS step FROM segs
),
unwrapped AS (
  SELECT event_type, seg, seg_rows, t_mid,
         phi + sum(CASE WHEN step > 90 THEN -180 WHEN step < -90 THEN 180 ELSE 0 END)
           OVER (PARTITION BY event_type ORDER BY seg) AS phi
  FROM turned
)"""


_ROTATION = f"""
{_segments()},
{_fit("t_mid", "phi", "unwrapped", "event_type, seg_rows")}"""

_TAXA = """
taxa AS (
  SELECT CAST(p_partkey AS VARCHAR) AS taxon_id, p_name AS scientific_name, p_brand AS german_name,
         ['species', 'genus', 'hybrid', 'family'][p_size % 4 + 1] AS rank,
         CASE p_type WHEN 'STANDARD' THEN 'active' WHEN 'MEDIUM' THEN 'stub' WHEN 'SMALL' THEN 'context'
                     WHEN 'LARGE' THEN 'structured_paraphrase' WHEN 'ECONOMY' THEN 'deprecated' END AS status,
         CASE WHEN p_size % 10 = 0 THEN 'exclude_from_identification'
              WHEN p_size % 10 = 1 THEN 'field|exclude_from_identification'
              WHEN p_size % 10 < 6 THEN 'field|photo' END AS app_scope,
         nullif(p_brand, 'Brand#3') AS family,
         ['Rothmaler_1.pdf', 'strasburger.pdf', 'rothmaler+Strasburger.pdf', 'andere.pdf'][p_partkey % 4 + 1]
           AS source_pdf
  FROM part
)"""
_FEATURES = """
features AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS feature_id,
         CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 0 THEN 'x' ELSE '' END || l_partkey AS taxon_id,
         l_returnflag AS organ, l_linestatus AS feature_group, 'c' || l_linenumber AS "character",
         strftime(l_shipdate, '%Y-%m-%d') AS state,
         CASE WHEN l_quantity >= 34 THEN 'high' WHEN l_quantity >= 17 THEN 'medium' ELSE 'low' END AS diagnostic_weight,
         CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END
           AS visibility_in_photo,
         CASE WHEN l_tax > 0.04 THEN 'Band 2' END AS source_note
  FROM lineitem
)"""
_HIDDEN = "'deprecated', 'reference_only', 'critical'"


def _visible(stubs: bool) -> str:
    hidden = _HIDDEN if stubs else f"{_HIDDEN}, 'stub'"
    return (
        f"coalesce(status, '') NOT IN ({hidden}) "
        "AND coalesce(app_scope, '') <> 'exclude_from_identification'"
    )


def _matches(query: str) -> str:
    pattern = _quote(f"%{query.strip().lower()}%")
    return "(" + " OR ".join(
        f"lower({c}) LIKE {pattern}" for c in ("scientific_name", "german_name", "taxon_id")
    ) + ")"


def _envelope(stubs: bool) -> str:
    return f"""
SELECT least(count(*), 50) AS "count", 50 AS "limit", count(*) >= 50 AS maybe_truncated,
       {str(stubs).lower()} AS include_stubs, count(*) AS total_hits
FROM taxa WHERE {_visible(stubs)} AND {_matches("ring")}"""


_BATCH = " UNION ALL ".join(
    f"""SELECT {_quote(q.strip())} AS query, CAST(row_number() OVER (ORDER BY taxon_id) AS INTEGER) AS position,
        taxon_id, scientific_name, status
        FROM taxa WHERE {_visible(False)} AND {_matches(q) if q.strip() else 'true'}"""
    for q in SEARCHES
)

_DOCS = r"""
docs AS (
  SELECT doc_id, lang, text || ' \cite[S.~1]{' || lower(regexp_extract(text, '\p{L}+')) || ', quelle2023}' ||
    CASE doc_id % 4 WHEN 1 THEN chr(10) || '\printbibliography' || chr(10) || '\end{document}'
                    WHEN 2 THEN chr(10) || '\printbibliography siehe oben \end{document}'
                    WHEN 3 THEN chr(10) || '% \cite{nirgends} TODO' || chr(10) || '\printbibliography \end{document}'
                    ELSE '' END AS tex
  FROM documents
),
bib AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN quality = 1
    THEN [lower(regexp_extract(text, '\p{L}+')), 'quelle2023'] ELSE ['quelle2023', 'the'] END) AS key
  FROM documents JOIN labels USING (doc_id)
),
bare AS (
  SELECT doc_id, lang, regexp_replace(tex, '(^|[^\\])((?:\\\\)*)%[^\n]*', '\1\2', 'g') AS tex FROM docs
),
cited AS (
  SELECT DISTINCT doc_id, trim(k) AS key FROM (
    SELECT doc_id, unnest(string_split(keys, ',')) AS k FROM (
      SELECT doc_id, unnest(regexp_extract_all(tex, '\\[A-Za-z]*[Cc]ite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}', 1)) AS keys
      FROM bare)
  ) WHERE trim(k) <> ''
),
words AS (
  SELECT DISTINCT doc_id, regexp_replace(w, '^[.:+/-]+|[.:+/-]+$', '', 'g') AS key FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      regexp_replace(tex, '\\[A-Za-z]*[Cc]ite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}', ' ', 'g'),
      '([\p{L}\p{M}\p{N}_:.+/-]+)', 1)) AS w FROM bare
  )
),
key_errors AS (
  SELECT doc_id, 'citation_missing' AS rule_id, 'error' AS severity, key
  FROM cited ANTI JOIN bib USING (doc_id, key)
  UNION ALL
  SELECT doc_id, 'citation_literal', 'error', key FROM words SEMI JOIN bib USING (doc_id, key)
)"""


def _portable(pattern: str) -> str:
    """The rule patterns use nothing but ASCII word borders, which both regex engines share."""
    return _quote(pattern)


_RULES = " UNION ALL ".join(
    f"SELECT doc_id, lang, {_quote(r.rule_id)} AS rule_id, {_quote(r.severity)} AS severity "
    f"FROM docs WHERE regexp_matches(tex, {_portable(r.pattern)})"
    for r in [*TEXT_RULES, *EXTRA_RULES]
)
_OWN = rf"""
own AS (
  {_RULES}
  UNION ALL SELECT doc_id, lang, 'bibliography_missing', 'error' FROM bare WHERE NOT contains(tex, '\printbibliography')
  UNION ALL SELECT doc_id, lang, 'bibliography_misplaced', 'error' FROM bare
    WHERE contains(tex, '\printbibliography')
      AND NOT regexp_matches(tex, '\\printbibliography\s*\\end\{{document\}}')
)"""

_TERMS = " UNION ALL ".join(
    f"SELECT doc_id, {_quote(t)} AS term FROM documents WHERE contains(lower(text), {_quote(t.lower())})"
    for t in [*FORBIDDEN_TERMS, *EXTRA_TERMS]
)

# ── report blocks by kind of file ────────────────────────────────────────────────────────────────

_ANGLE = ["angle_time_plot", "latitude_result", "angular_regression", "gaussian_error_template"]
_TUBE = [
    "rubensrohr_sound_speed_table",
    "rubensrohr_inverse_frequency_plot",
    "rubensrohr_sound_speed_result",
    "rubensrohr_inverse_frequency_regression",
    "gaussian_error_template",
]
_ALWAYS = ["raw_statistics", "column_profile", "missing_values_summary", "dataset_overview"]
_PARAMETERS = EXPECTED_PARAMETERS
_KIND_ITEMS = {0: _ANGLE, 1: _ANGLE, 2: _ANGLE, 3: ["gaussian_error_template"], 4: _TUBE, 5: []}
_KIND_WARNINGS = {
    0: [],
    1: [],
    2: [],
    3: ["no_time_angle_regression", "xy_tracking_no_angle"],
    4: [],
    5: ["ambiguous_physical_interpretation"],
}


def _block_rows() -> str:
    order = {name: i for i, name in enumerate(SECTIONS)}
    rows = []
    for kind in range(6):
        for item in [*_ALWAYS, *_KIND_ITEMS[kind]]:
            array, place = ITEMS[item][0], ITEMS[item][1]
            rows.append((kind, order[array], place * 1000, item, array, "", ITEMS[item][2]))
        for item in _KIND_WARNINGS[kind]:
            place = DATASET_WARNINGS[item][0]
            rows.append((kind, 4, place * 1000, item, "warnings", "", DATASET_WARNINGS[item][1]))
        if kind < 4:
            for i, name in enumerate(_PARAMETERS):
                title = f"Fehlender Parameter: {name}"
                rows.append((kind, 4, 6000 + i, f"missing_{name}", "warnings", name, title))
    return ",\n".join(
        f"({k}, {s}, {o}, {_quote(i)}, {_quote(a)}, {_quote(p)}, {_quote(t)})" for k, s, o, i, a, p, t in rows
    )


_SECTION = "CASE source_array " + " ".join(
    f"WHEN {_quote(a)} THEN {_quote(s)}" for a, s in SECTIONS.items()
) + " END"
_BLOCKS = f"""
{_CELLS},
catalogue(kind, section_ord, ord, id, source_array, parameter, title) AS (VALUES {_block_rows()}),
runs AS (SELECT DISTINCT dataset_id, kind FROM m),
per_column AS (
  SELECT dataset_id, kind, col_idx, "column", count(num) AS n, count(DISTINCT num) AS u, count(txt) AS n_txt,
         count(*) AS n_all
  FROM cells GROUP BY ALL
),
found AS (
  SELECT dataset_id, section_ord, ord, id, source_array, title FROM runs JOIN catalogue USING (kind)
  WHERE NOT (parameter = 'mass' AND dataset_id % 4 = 1)
  UNION ALL
  SELECT dataset_id, 4, 1000 + col_idx,
         CASE WHEN n + n_txt = 0 THEN 'empty_column_' ELSE 'constant_numeric_column_' END || "column", 'warnings',
         CASE WHEN n + n_txt = 0 THEN 'Leere Spalte: ' ELSE 'Konstante numerische Spalte: ' END || "column"
  FROM per_column WHERE n + n_txt = 0 OR u = 1
),
blocks AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY section_ord, ord, id) AS block,
         {_SECTION} AS section, rtrim(source_array, 's') AS type
  FROM found
)"""

_SELECTED_NOT = "id = 'column_profile'"


def _description_rows() -> str:
    """Descriptions and hints by id; those of a column's warning by the beginning of the id."""
    rows = [(name, values[3], values[6]) for name, values in ITEMS.items()]
    rows += [(name, values[2], "") for name, values in DATASET_WARNINGS.items()]
    rows += [(f"missing_{p}", f"{p} wurde nicht in den Metadaten bereitgestellt.", "") for p in EXPECTED_PARAMETERS]
    rows += [(name.split("_")[0], values[1], "") for name, values in COLUMN_WARNINGS.items()]
    return ", ".join(f"({_quote(a)}, {_quote(b)}, {_quote(c)})" for a, b, c in rows)


def oracle() -> dict[str, str]:
    queries = {
        "linear_regression": f"""
WITH {_fit("l_quantity", "l_extendedprice", "lineitem", "l_returnflag")}
SELECT l_returnflag, n, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(r * r, 8) AS r_squared,
       round(stderr, 6) AS slope_stderr, round(stderr * sqrt(sxx / n + mx * mx), 5) AS intercept_stderr
FROM fit""",
        "regression_pvalue": f"""
WITH e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS x, value AS y FROM events),
{_fit("x", "y", "e", "user_id")}, {_P_VALUE}
SELECT user_id, n, round(p_value, 6) AS p_value FROM p""",
        "numeric_stats": " UNION ALL ".join(
            f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, round(avg({c}), 5) AS mean,
            round(stddev_samp({c}), 5) AS sample_std, round(stddev_samp({c}) / sqrt(count({c})), 6) AS sem,
            min({c}) + 0.0 AS "min", max({c}) AS "max" FROM lineitem GROUP BY l_returnflag"""
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ),
        "file_stats": f"""
WITH {_CELLS}
SELECT dataset_id, col_idx, "column", count(num) AS n, CAST(avg(num) AS FLOAT) AS mean,
       round(stddev_samp(num), 4) AS sample_std, round(stddev_samp(num) / sqrt(count(num)), 5) AS sem,
       min(num) AS "min", max(num) AS "max", CAST(0 AS BIGINT) AS nonfinite_count
FROM cells GROUP BY dataset_id, col_idx, "column" HAVING count(num) > 0""",
        "column_profile": f"""
WITH {_CELLS}, counted AS (
  SELECT dataset_id, col_idx, "column", count(num) + count(txt) AS non_missing_count,
         count(*) - count(num) - count(txt) AS missing_count, count(num) AS numeric_count, count(txt) AS text_count,
         count(DISTINCT num) + count(DISTINCT txt) AS unique_count
  FROM cells GROUP BY ALL
)
SELECT *, CASE WHEN non_missing_count = 0 THEN 'empty' WHEN text_count = 0 THEN 'numeric'
               WHEN numeric_count = 0 THEN 'text' ELSE 'mixed' END AS inferred_type,
       non_missing_count > 0 AND unique_count = 1 AS is_constant
FROM counted""",
        "missing_summary": f"""
WITH {_CELLS}, c AS (
  SELECT dataset_id, "column", count(*) - count(num) - count(txt) AS missing_count FROM cells GROUP BY ALL
)
SELECT dataset_id, CAST(sum(missing_count) OVER (PARTITION BY dataset_id) AS BIGINT) AS total_missing_values,
       "column", missing_count FROM c""",
        "dataset_overview": f"""
WITH {_CELLS}, c AS (
  SELECT dataset_id, col_idx, "column", count(*) AS n, count(num) AS n_num,
         count(*) - count(num) - count(txt) AS missing FROM cells GROUP BY ALL
)
SELECT dataset_id, max(n) AS row_count, count(*) AS column_count, CAST(sum(missing) AS BIGINT) AS missing_values,
       string_agg("column", '|' ORDER BY col_idx) FILTER (WHERE n_num > 0) AS detected_numeric_columns
FROM c GROUP BY dataset_id""",
        "numeric_normalise": """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN p_retailprice * 10 WHEN 2 THEN NULL
                  ELSE p_retailprice END AS num FROM part""".replace(
            "p_retailprice * 10", "CAST(CAST(p_retailprice AS VARCHAR) || 'e1' AS DOUBLE)"
        ),
        "read_lines": f"""
WITH {_MEASURED}, heads(kind, chars) AS (VALUES {", ".join(f"({i}, {len(h)})" for i, (_, h) in enumerate(RUN_KINDS))})
SELECT dataset_id, count(*) + 1 AS n_lines, CAST(max(chars) + sum(
  length(printf('%d.%06d', CAST(floor(t) AS BIGINT), CAST(round((t - floor(t)) * 1000000) AS BIGINT)))
  + length(CAST(v AS VARCHAR)) + length(CAST(CAST(k AS BIGINT) AS VARCHAR)) + length(coalesce(typ, '')) + 3) AS BIGINT)
  AS n_chars
FROM m JOIN heads USING (kind) GROUP BY dataset_id""",
        "delimiter_detect": f"""
WITH {_MEASURED}, {_NAMES}, l AS (SELECT kind, string_agg("column", '|' ORDER BY col_idx) AS names FROM names GROUP BY kind)
SELECT DISTINCT dataset_id, CASE WHEN kind IN (1, 4) THEN ';' WHEN kind = 2 THEN chr(9) ELSE ',' END AS delimiter,
       names, CAST(23 AS DOUBLE) AS score, true AS ref_accepts, CAST(NULL AS VARCHAR) AS error
FROM m JOIN l USING (kind)""",
        "parse_cells": f"""
WITH {_CELLS}
SELECT dataset_id, col_idx, count(*) AS n_cells, count(num) + count(txt) AS n_raw, count(num) AS n_num,
       round(sum(num), 3) AS total FROM cells GROUP BY dataset_id, col_idx""",
        "hard_files": """
WITH e AS (
  SELECT event_id // 200 AS dataset_id, (event_id // 200) % 7 AS kind, event_id % 200 + 1 AS place,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
), c AS (
  SELECT dataset_id, kind, count(*) AS n, sum(k) AS k, sum(place) AS p,
         count(*) FILTER (WHERE place % 3 = 0) AS n0, count(*) FILTER (WHERE place % 3 = 1) AS n1,
         count(*) FILTER (WHERE place % 3 = 2) AS n2, sum(place) FILTER (WHERE place % 3 > 0) AS p12 FROM e GROUP BY ALL
)
SELECT dataset_id, 0 AS col_idx, 'x' AS "column", n AS n_raw, n AS n_num, 0 AS n_infinite, k AS total, NULL AS reason FROM c WHERE kind = 0
UNION ALL SELECT dataset_id, 1, 'x.2', 0, 0, 0, NULL, NULL FROM c WHERE kind = 0
UNION ALL SELECT dataset_id, 2, 'x.1', n, n, 0, p, NULL FROM c WHERE kind = 0
UNION ALL SELECT dataset_id, 0, 'a', n, n, 0, 1.5 * n, NULL FROM c WHERE kind = 1
UNION ALL SELECT dataset_id, 1, 'b,c', n, 0, 0, NULL, NULL FROM c WHERE kind = 1
UNION ALL SELECT dataset_id, 2, 'Unnamed: 2', 0, 0, 0, NULL, NULL FROM c WHERE kind = 1
UNION ALL SELECT dataset_id, 0, 'wert', n, n, 0, k + 0.5 * n, NULL FROM c WHERE kind = 2
UNION ALL SELECT dataset_id, NULL, NULL, NULL, NULL, NULL, NULL, 'row_overflow' FROM c WHERE kind = 3
UNION ALL SELECT dataset_id, NULL, NULL, NULL, NULL, NULL, NULL, 'unterminated_quote' FROM c WHERE kind = 4
UNION ALL SELECT dataset_id, 0, 't', n, n, n0, p12, NULL FROM c WHERE kind = 5
UNION ALL SELECT dataset_id, 1, 'v', n0 + n2, n0 + n2, n2, n0, NULL FROM c WHERE kind = 5
UNION ALL SELECT dataset_id, 0, 'k', n, n, 0, k, NULL FROM c WHERE kind = 6
UNION ALL SELECT dataset_id, 1, 'notiz' || chr(10) || 'lang', n, 0, 0, NULL, NULL FROM c WHERE kind = 6
UNION ALL SELECT dataset_id, 2, 'p', n, n, 0, p, NULL FROM c WHERE kind = 6""",
        "multiline_cells": """
SELECT source AS dataset_id, doc_id, md5(text) AS text_md5, length(text) AS n_chars, lang, doc_id AS place FROM documents""",
        "tracking_read": f"""
WITH {_MEASURED}
SELECT dataset_id, count(*) AS n, round(sum(t), 3) AS sum_t, round(sum(v), 3) AS sum_x, sum(k) AS sum_y,
       CAST(0 AS BIGINT) AS n_area
FROM m WHERE event_type <> 'error' GROUP BY dataset_id""",
        "role_binding": f"""
WITH {_MEASURED}, {_NAMES}, runs AS (SELECT DISTINCT dataset_id, kind FROM m), hits AS (
  SELECT dataset_id, col_idx, "column", unnest(list_filter([
    CASE WHEN regexp_matches(lower("column"), '^t$|time|zeit') THEN 'time' END,
    CASE WHEN regexp_matches(lower("column"), 'angle|winkel|phi') THEN 'angle' END,
    CASE WHEN regexp_matches(lower("column"), '^(frequency_hz|frequency|frequenz|f|f_hz|hz)$') THEN 'frequency' END,
    CASE WHEN regexp_matches(lower("column"), '^(peak_spacing_m|peak_spacing|spacing|abstand|d|d_m)$') THEN 'spacing' END,
    CASE WHEN regexp_matches(lower("column"), '^x$|^x_px$|x.*pixel|center.*x|^cx$') THEN 'x_track' END,
    CASE WHEN regexp_matches(lower("column"), '^y$|^y_px$|y.*pixel|center.*y|^cy$') THEN 'y_track' END
  ], lambda h: h IS NOT NULL)) AS role
  FROM runs JOIN names USING (kind)
)
SELECT dataset_id, role, CAST(min(col_idx) AS INTEGER) AS col_idx, arg_min("column", col_idx) AS "column"
FROM hits GROUP BY dataset_id, role""",
        "angular_regression": f"""
WITH {_MEASURED}, {_fit("t", "v", "m", "dataset_id", "kind < 3")}, {_P_VALUE}
SELECT dataset_id, n, round(slope, 9) AS slope, round(intercept, 4) AS intercept, round(r, 7) AS r_value,
       round(r * r, 7) AS r_squared, round(p_value, 5) AS p_value, round(stderr, 9) AS stderr FROM p""",
        "resonance_points": f"""
WITH {_MEASURED}
SELECT dataset_id, row_idx, k AS frequency_hz, v AS peak_spacing_m, round(2 * v, 6) AS wavelength_m,
       round(k * (2 * v), 6) AS sound_speed_m_s, round(1 / k, 9) AS inverse_frequency_s
FROM m WHERE kind = 4 AND k > 0 AND v > 0""",
        "resonance_speed": """
WITH c AS (SELECT l_linestatus AS dataset_id, l_quantity * (2 * l_discount) AS c FROM lineitem
           WHERE l_quantity > 0 AND l_discount > 0)
SELECT dataset_id, count(*) AS n, round(avg(c), 6) AS speed_mean, round(stddev_samp(c), 6) AS speed_sample_std,
       round(stddev_samp(c) / sqrt(count(*)), 6) AS speed_sem, round(min(c), 6) AS speed_min,
       round(max(c), 6) AS speed_max FROM c GROUP BY dataset_id""",
        "inverse_regression": f"""
WITH i AS (SELECT l_linestatus AS dataset_id, 1 / l_quantity AS x, l_discount AS y FROM lineitem
           WHERE l_quantity > 0 AND l_discount > 0), {_fit("x", "y", "i", "dataset_id")}
SELECT dataset_id, n, round(slope, 9) AS slope, round(intercept, 9) AS intercept, round(stderr, 9) AS slope_stderr,
       round(stderr * sqrt(sxx / n + mx * mx), 9) AS intercept_stderr, round(2 * slope, 9) AS c_regression_m_s,
       round(2 * stderr, 9) AS c_regression_stderr_m_s, round(r * r, 9) AS r_squared FROM fit""",
        "latitude": f"""
WITH {_MEASURED}, {_fit("t", "v", "m", "dataset_id", "kind < 3")}, o AS (
  SELECT f.dataset_id, CASE f.dataset_id % 4 WHEN 0 THEN f.slope WHEN 1 THEN e.v / 1000000 END AS omega
  FROM fit f JOIN (SELECT dataset_id, v FROM m WHERE row_idx = 1) e USING (dataset_id)
), q AS (SELECT *, omega / 7.2921159e-5 AS ratio FROM o)
SELECT dataset_id, ratio IS NULL OR abs(ratio) > 1 AS not_computable,
       CASE WHEN omega IS NULL THEN {_quote(REASON_UNIT)} WHEN abs(ratio) > 1 THEN {_quote(REASON_DOMAIN)} END AS reason,
       round(omega, 9) AS omega_mess_rad_s,
       round(CASE WHEN abs(ratio) <= 1 THEN degrees(asin(ratio)) END, 4) AS latitude_deg,
       false AS correction_factor_used FROM q""",
        "latitude_error": f"""
WITH {_traces("user_id")}, {_fit("t", "x", "s", "user_id")}, a AS (
  SELECT user_id, abs(slope * 150000) / 15.041 AS sine, stderr * 150000 AS error FROM fit
), b AS (
  SELECT user_id, sine, CASE WHEN sine <= 1 THEN degrees(asin(sine)) END AS phi,
         CASE WHEN sine <= 1 THEN error / (15.041 * sqrt(greatest(1 - sine * sine, 1e-10))) END AS d FROM a
)
SELECT user_id, round(sine, 6) AS sin_phi, round(phi, 5) AS phi_exp, round(d, 5) AS delta_phi_ref,
       round(degrees(d), 4) AS delta_phi_deg, round(abs(phi - 52.52), 5) AS abw_deg,
       round(abs(phi - 52.52) / d, 3) AS abw_sigma, sine > 1 AS outside FROM b""",
        "error_propagation": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(sqrt(l_discount * l_discount + l_tax * l_tax), 9) AS combined,
       round(sqrt(l_discount * l_discount + l_tax * l_tax + l_quantity * l_quantity), 7) AS combined3,
       round(l_discount / (l_quantity * l_quantity), 9) AS frequency_error,
       round(2 * pi() * l_discount / (l_quantity * l_quantity), 9) AS omega_error,
       round(9.81 * l_quantity * l_quantity / (4 * pi() * pi()), 6) AS length_m,
       round(2 * 9.81 * l_quantity * l_discount / (4 * pi() * pi()), 8) AS length_error,
       round(l_discount * 3600, 4) AS per_hour, round(l_quantity / 60, 8) AS minutes FROM lineitem""",
        "successive_difference": f"""
WITH {_traces("user_id")}, d AS (
  SELECT user_id, row_idx, t - lag(t) OVER (PARTITION BY user_id ORDER BY row_idx) AS dt FROM s
)
SELECT user_id, row_idx, round(dt, 6) AS dt FROM d WHERE dt IS NOT NULL""",
        "sampling_summary": f"""
WITH {_traces("user_id")}, d AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY row_idx) AS dt FROM s
), a AS (
  SELECT user_id, count(*) AS n, median(dt) AS dt_s, arg_max(t, row_idx) - arg_min(t, row_idx) AS duration_s
  FROM d GROUP BY user_id
)
SELECT user_id, n, round(dt_s, 8) AS dt_s, round(1 / dt_s, 9) AS fs_hz, round(duration_s, 4) AS duration_s,
       round(duration_s / 60, 4) AS duration_min FROM a""",
        "channel_stats": f"WITH {_traces('event_type')} " + " UNION ALL ".join(
            f"""SELECT event_type, '{c}' AS channel, count({c}) AS n, round(avg({c}), 3) AS mean,
            round(stddev_samp({c}), 3) AS sample_std, round(stddev_samp({c}) / sqrt(count({c})), 3) AS sem,
            round(min({c}), 3) AS "min", round(max({c}), 3) AS "max" FROM s GROUP BY event_type"""
            for c in ("t", "x", "y", "area")
        ),
        "trajectory_extent": f"""
WITH {_traces("user_id")}, a AS (
  SELECT user_id, avg(x) AS x_mean, avg(y) AS y_mean, (max(x) - min(x)) / 2 AS ax, (max(y) - min(y)) / 2 AS ay
  FROM s GROUP BY user_id
)
SELECT user_id, round(x_mean, 9) AS x_mean, round(y_mean, 9) AS y_mean, round(ax, 9) AS ax, round(ay, 9) AS ay,
       round(CASE WHEN ax > 0 THEN ay / ax END, 9) AS ellipticity FROM a""",
        "tracking_quality": f"""
WITH {_traces("user_id")}
SELECT user_id, round(avg(area), 9) AS area_mean, round(stddev_samp(area), 9) AS area_s,
       round(stddev_samp(area) / avg(area) * 100, 9) AS area_cv FROM s GROUP BY user_id""",
        "zero_crossings": f"""
WITH {_crossings("user_id")} SELECT user_id, row_idx, round(t_cross, 3) AS t_cross FROM crossings""",
        "periods": f"""
WITH {_crossings("user_id")} SELECT user_id, row_idx, round(period, 3) AS period FROM periods""",
        "period_stats": f"""
WITH {_crossings("user_id")}, a AS (
  SELECT user_id, count(*) AS n, avg(period) AS p, stddev_samp(period) AS sd,
         stddev_samp(period) / sqrt(count(*)) AS e
  FROM periods GROUP BY user_id HAVING count(*) >= 3
)
SELECT user_id, n AS n_periods, round(p, 3) AS period_s, round(sd, 3) AS period_std_s, round(e, 3) AS period_error_s,
       round(1 / p, 10) AS frequency_hz, round(e / (p * p), 10) AS frequency_error_hz, round(2 * pi() / p, 10) AS omega0,
       round(2 * pi() * e / (p * p), 10) AS omega0_error, round(9.81 * p * p / (4 * pi() * pi()), 0) AS length_m,
       round(2 * 9.81 * p * e / (4 * pi() * pi()), 0) AS length_error_m FROM a""",
        "period_histogram": f"""
WITH {_crossings("event_type")}, e AS (
  SELECT event_type, min(period) AS lo, max(period) AS hi FROM periods GROUP BY event_type HAVING count(*) >= 3
)
SELECT event_type, CAST(least(floor((period - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin,
       round(max(lo + (hi - lo) / 20 * least(floor((period - lo) / (hi - lo) * 20), 19)), 3) AS bin_start, count(*) AS n
FROM periods JOIN e USING (event_type) GROUP BY 1, 2""",
        "segment_axis": f"""
WITH {_segments()}
SELECT event_type, seg, seg_rows, round(t_mid, 4) AS t_mid, round(phi, 6) AS phi FROM segs""",
        "segment_axis_consistent": f"""
WITH {_segments("covar_samp")} SELECT event_type, seg, round(phi, 6) AS phi FROM segs""",
        "angle_unwrap": f"""
WITH {_segments()} SELECT event_type, seg, round(phi, 6) AS phi FROM unwrapped""",
        "plane_rotation": f"""
WITH {_ROTATION}, a AS (SELECT *, abs(slope * 3600) / 15.041 AS sine FROM fit)
SELECT event_type, n AS n_seg, seg_rows, round(intercept, 5) AS phi0_deg,
       round(stderr * sqrt(sxx / n + mx * mx), 5) AS phi0_error, round(slope, 10) AS b_deg_s,
       round(stderr, 10) AS b_error, round(slope * 3600, 6) AS b_h, round(stderr * 3600, 6) AS b_h_error,
       round(r * r, 7) AS r2, round(sqrt(rss / greatest(n - 2, 1)), 5) AS s_y, round(sine, 7) AS sin_phi,
       round(CASE WHEN sine <= 1 THEN degrees(asin(sine)) END, 5) AS phi_exp,
       round(CASE WHEN sine <= 1 THEN abs(degrees(asin(sine)) - 52.52) END, 5) AS abw_deg FROM a""",
        "rotation_residuals": f"""
WITH {_ROTATION}
SELECT event_type, seg, round(phi - (intercept + slope * t_mid), 5) AS residual
FROM unwrapped JOIN fit USING (event_type)""",
        "coordinate_export": f"""
WITH {_ROTATION}, c AS (
  SELECT event_type, string_agg(printf('(%.1f,%.4f)', t_mid, phi), ' ' ORDER BY seg) AS coords
  FROM unwrapped GROUP BY event_type
)
SELECT event_type, coords, round(intercept, 4) AS fit_a, round(slope, 7) AS fit_b,
       printf('%.4f + %.7f*x', intercept, slope) AS fit_formula FROM c JOIN fit USING (event_type)""",
        "slice_angles": f"""
WITH {_traces("event_type")}, z AS (SELECT event_type, CAST(floor(t / 86400) AS BIGINT) AS slice, x, y FROM s),
{_fit("x", "y", "z", "event_type, slice")}
SELECT event_type, slice, n, round(degrees(atan(slope)), 6) AS alpha_deg FROM fit""",
        "arriving_slices": f"""
WITH {_traces("event_type")}, {_HELD}, z AS (SELECT event_type, CAST(floor(t / 86400) AS BIGINT) AS slice, x, y FROM h WHERE NOT held),
{_fit("x", "y", "z", "event_type, slice")}
SELECT event_type, slice, n, round(degrees(atan(slope)), 6) AS alpha_deg FROM fit""",
        "late_slice_samples": f"""
WITH {_traces("event_type")}, {_HELD}
SELECT event_type, CAST(floor(t / 86400) AS BIGINT) AS slice, count(*) AS n_late FROM h WHERE held GROUP BY ALL""",
        "pendulum_results": f"""
WITH {_crossings("event_type")}, p AS (SELECT event_type, count(*) AS n_periods FROM periods GROUP BY event_type)
SELECT event_type, 'Versuch' AS title, count(*) AS n, max(n_periods) AS n_periods, CAST(30 AS BIGINT) AS n_seg
FROM s JOIN p USING (event_type) GROUP BY event_type""",
        "catalog_search": f"""
WITH {_TAXA} SELECT * FROM taxa WHERE {_visible(True)} AND {_matches("_ED r")} ORDER BY taxon_id LIMIT 50""",
        "search_envelope": f"WITH {_TAXA} {_envelope(False)} UNION ALL {_envelope(True)}",
        "batch_search": f"WITH {_TAXA}, hits AS ({_BATCH}) SELECT * FROM hits WHERE position <= 50",
        "find_taxon": f"WITH {_TAXA} SELECT * FROM taxa WHERE taxon_id = '17'",
        "taxon_labels": f"""
WITH {_TAXA}
SELECT taxon_id, CASE status WHEN 'active' THEN 'geprüft' WHEN 'stub' THEN 'vorläufig' WHEN 'context' THEN 'Kontext'
         WHEN 'structured_paraphrase' THEN 'strukturierte Paraphrase' ELSE coalesce(status, '') END AS status_label,
       ['Rothmaler', 'Strasburger', 'Rothmaler + Strasburger', 'andere.pdf'][CAST(taxon_id AS BIGINT) % 4 + 1]
         AS source_label FROM taxa""",
        "photo_features": f"""
WITH {_TAXA}, {_FEATURES}
SELECT f.feature_id, f.taxon_id, f.organ, f."character", t.scientific_name, t.german_name, t.rank
FROM features f LEFT JOIN taxa t USING (taxon_id)
WHERE f.visibility_in_photo = 'high' AND f.diagnostic_weight = 'high'
ORDER BY t.scientific_name NULLS FIRST, f.organ, f."character", f.feature_id LIMIT 100""",
        "feature_text_filter": f"""
WITH {_TAXA}, {_FEATURES}
SELECT f.feature_id, f.taxon_id, t.scientific_name, t.german_name
FROM features f LEFT JOIN taxa t USING (taxon_id)
WHERE f.visibility_in_photo = 'medium' AND f.diagnostic_weight = 'medium'
  AND contains(lower(coalesce(t.scientific_name, '') || ' ' || coalesce(t.german_name, '') || ' ' || f."character"
    || ' ' || f.state || ' ' || f.organ || ' ' || f.feature_group || ' ' || f.taxon_id || ' '
    || coalesce(f.source_note, '')), 'ring brand#1')""",
        "table_search": f"""
WITH {_TAXA}, texts AS (
  SELECT DISTINCT trim(CASE p_partkey % 6 WHEN 0 THEN upper(piece) WHEN 1 THEN replace(piece, 'e', '_')
    WHEN 2 THEN ' ' || p_name[1:2] || '%' || p_name[-3:] WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 4 THEN lower(p_brand)
    ELSE repeat('_', CAST(p_size % 20 AS BIGINT)) END) AS query FROM (SELECT *, substr(p_name, 2, CAST(p_size % 7 + 1 AS BIGINT)) AS piece FROM part)
), hits AS (
  SELECT query, taxon_id, scientific_name, status, row_number() OVER (PARTITION BY query ORDER BY taxon_id) AS position
  FROM texts JOIN taxa ON {_visible(False)} AND (query = '' OR lower(scientific_name) LIKE '%' || lower(query) || '%'
    OR lower(german_name) LIKE '%' || lower(query) || '%' OR lower(taxon_id) LIKE '%' || lower(query) || '%')
)
SELECT query, position, taxon_id, scientific_name, status FROM hits WHERE position <= 50""",
        "taxon_detail": f"""
WITH {_TAXA}, {_FEATURES}
SELECT t.taxon_id, t.scientific_name, count(f.feature_id) OVER (PARTITION BY t.taxon_id) AS features_count,
       CASE WHEN f.feature_id IS NOT NULL THEN row_number() OVER (
         PARTITION BY t.taxon_id ORDER BY f.organ, f.feature_group, f."character", f.feature_id) END AS position,
       f.feature_id, f.organ, f.feature_group, f."character", f.state, f.diagnostic_weight
FROM taxa t LEFT JOIN features f USING (taxon_id)""",
        "hot_taxon_detail": f"""
WITH {_FEATURES}
SELECT organ AS taxon_id, 'flag ' || organ AS scientific_name, count(*) OVER (PARTITION BY organ) AS features_count,
       row_number() OVER (PARTITION BY organ ORDER BY feature_group, "character", feature_id) AS position,
       feature_id, organ, feature_group, "character", state, diagnostic_weight FROM features""",
        "active_without_features": f"""
WITH {_TAXA}, {_FEATURES}
SELECT taxon_id, rank, status FROM taxa t
WHERE status = 'active' AND rank IN ('species', 'genus', 'hybrid') AND NOT EXISTS (
  SELECT 1 FROM features f WHERE f.taxon_id = t.taxon_id AND f.diagnostic_weight = 'high' AND f.visibility_in_photo = 'high')""",
        "dangling_features": f"""
WITH {_TAXA}, {_FEATURES}
SELECT taxon_id, count(*) AS n_features FROM features f
WHERE NOT EXISTS (SELECT 1 FROM taxa t WHERE t.taxon_id = f.taxon_id) GROUP BY taxon_id""",
        "catalog_expectations": f"""
WITH {_TAXA}, c AS (
  SELECT count(*) FILTER (WHERE {_matches("ring")} AND {_visible(False)}) AS std,
         count(*) FILTER (WHERE {_matches("ring")} AND {_visible(True)}) AS stubs,
         count(*) FILTER (WHERE taxon_id IN ('3', '5') AND {_visible(False)}) AS excluded FROM taxa
)
SELECT 'standard_search_finds_taxa' AS name, std > 0 AS passed, std AS observed FROM c
UNION ALL SELECT 'stub_search_finds_no_less', stubs >= std, stubs FROM c
UNION ALL SELECT 'hidden_statuses_not_found', true, CAST(0 AS BIGINT) FROM c
UNION ALL SELECT 'excluded_taxa_not_found', excluded = 0, excluded FROM c
UNION ALL SELECT 'release_fields_present', count(*) FILTER (WHERE r_name = 'ASIA') = 0,
                 count(*) FILTER (WHERE r_name = 'ASIA') FROM region""",
        "completeness": f"WITH {_TAXA} " + " UNION ALL ".join(
            f"""SELECT status, rank, count(*) AS n_rows, '{c}' AS "column",
            count(*) FILTER (WHERE coalesce(trim({c}), '') = '') AS n_empty FROM taxa GROUP BY status, rank"""
            for c in ("family", "app_scope", "german_name")
        ),
        "scope_tags": f"""
WITH {_TAXA}
SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(app_scope, '|')) AS tag FROM taxa) GROUP BY tag""",
        "forbidden_terms": _TERMS,
        "text_rules": f"""
WITH {_DOCS}, {_OWN} SELECT lang, rule_id, severity, count(*) AS n FROM own GROUP BY ALL""",
        "table_rules": r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS word FROM benchmark),
r AS (
  SELECT word, length(word) % 2 = 1 AS whole, '(^|[^a-z])' || word || '([^a-z]|$)' AS pattern FROM w
)
SELECT lang, word AS rule_id, CASE WHEN whole THEN 'error' ELSE 'warning' END AS severity, count(*) AS n
FROM documents JOIN r ON CASE WHEN contains(lower(text), word) THEN NOT whole OR regexp_matches(text, pattern) ELSE false END
GROUP BY ALL""",
        "citation_rules": f"WITH {_DOCS} SELECT * FROM key_errors",
        "uncited_entries": f"WITH {_DOCS} SELECT doc_id, key FROM bib ANTI JOIN cited USING (doc_id, key)",
        "bibliography_files": "SELECT source, 'article' AS entry_type, 'key' || doc_id AS \"key\" FROM documents",
        "doc_quality": f"""
WITH {_DOCS}, {_OWN}, found AS (
  SELECT doc_id, severity FROM own UNION ALL SELECT doc_id, severity FROM key_errors
)
SELECT d.doc_id, count(*) FILTER (WHERE severity = 'error') AS n_errors,
       count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
       count(*) FILTER (WHERE severity = 'error') = 0 AS passed
FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id""",
        "citations_missing": r"""
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS key FROM documents),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS key FROM benchmark)
SELECT key, count(*) AS n_docs FROM c ANTI JOIN b USING (key) GROUP BY key""",
        "fence_clean": r"""
WITH w AS (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '```LaTeX' || chr(10) || text || chr(10) || '```' || chr(10)
    WHEN 1 THEN 'Hier: \documentclass{article}' || chr(10) || text || ' ' ELSE '``` ' || text END AS text
  FROM conversations
), c AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^```(?:latex|tex)?\s*', '', 'i'),
    '\s*```\s*$', ''), '^\s+|\s+$', '', 'g') AS text FROM w
)
SELECT conv_id, turn, CASE WHEN instr(text, '\documentclass') > 1
  THEN substr(text, instr(text, '\documentclass')) ELSE text END AS text FROM c""",
        "payload_scrub": """
SELECT event_id, '{"experiment_title":"' || event_type || '","selected_analysis_blocks":[{"id":"a","content":{"k":'
  || k || '}},{"id":"b","content":{"k":' || (k + 1) || '}}],"metadata":{"user":' || user_id || '}}' AS payload
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
        "payload_scrub_open": """
SELECT event_id, '{"experiment_title":"' || event_type || '","metadata":{"user":' || user_id ||
  '},"selected_analysis_blocks":[{"content":{"k":' || k || '},"id":"a"},{"content":{"k":' || (k + 1) || '},"id":"b"}]}' AS payload,
  4 AS n_warnings
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
        "scrub_audit": """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 'selected_analysis_blocks[].content.csv' AS path,
       CASE WHEN event_type = 'view' THEN 1 ELSE 2 END::BIGINT AS n FROM e
UNION ALL SELECT event_id, 'metadata.file_content', 1 FROM e
UNION ALL SELECT event_id, 'raw_csv', 1 FROM e WHERE k % 2 = 0""",
        "generation_payloads": """
SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN 'preferred' WHEN 1 THEN 'preferred' WHEN 2 THEN 'messages' END
         AS kind,
       CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 = 0 END AS own_system,
       CASE WHEN doc_id % 4 < 2 THEN source END AS title, CASE WHEN doc_id % 4 = 1 THEN text END AS notes,
       CASE WHEN doc_id % 4 = 1 THEN '5' END AS mass,
       concat_ws('|',
         CASE WHEN lang = 'de' THEN 'Rohdatenfeld ignoriert: raw_csv' END,
         CASE doc_id % 4 WHEN 1 THEN 'Rohdatenfeld ignoriert: metadata.file_content'
                         WHEN 2 THEN 'Rohdatenfeld ignoriert: [].csv' END) AS warnings,
       CASE WHEN doc_id % 4 = 3 THEN 'messages oder bevorzugter Generate-Payload erforderlich.' END AS error
FROM documents""",
        "preview_blocks": f"""
WITH {_BLOCKS} SELECT dataset_id, block, id, type, section, source_array FROM blocks""",
        "selected_blocks": f"""
WITH {_BLOCKS}, missing AS (SELECT dataset_id, sum(n_all - n - n_txt) AS missing FROM per_column GROUP BY dataset_id)
SELECT dataset_id, section, count(*) AS n_selected FROM blocks JOIN missing USING (dataset_id)
WHERE id <> 'column_profile' AND NOT (id = 'missing_values_summary' AND missing = 0) GROUP BY dataset_id, section""",
        "analysis_warnings": f"""
WITH {_BLOCKS} SELECT dataset_id, id, title FROM blocks WHERE source_array = 'warnings'""",
        "generation_summaries": f"""
WITH {_CELLS}, c AS (
  SELECT dataset_id, col_idx, "column", count(*) AS n, count(num) AS n_num FROM cells GROUP BY ALL
)
SELECT dataset_id, '{{"used_all_rows":true,"row_count":' || max(n) || ',"column_count":' || count(*)
  || ',"detected_numeric_columns":[' || string_agg('"' || "column" || '"', ',' ORDER BY col_idx) FILTER (WHERE n_num > 0)
  || '],"selected_item_rule":"{SELECTED_ITEM_RULE}"}}' AS summary, CAST(NULL AS VARCHAR) AS error
FROM c GROUP BY dataset_id""",
        "analysis_reports": f"""
WITH {_BLOCKS}, sizes AS (SELECT dataset_id, kind, count(*) AS row_count FROM m GROUP BY ALL),
described AS (
  SELECT dataset_id, string_agg(concat("column", ':', n, ':', printf('%.3f', lo), ':', printf('%.3f', hi)), ' ' ORDER BY col_idx) FILTER (WHERE n > 0) AS statistics,
         string_agg(concat("column", ':', CASE WHEN n + n_txt = 0 THEN 'empty' WHEN n_txt = 0 THEN 'numeric' WHEN n = 0 THEN 'text' ELSE 'mixed' END, ':',
           n_all - n - n_txt, ':', u + u_txt, ':', n + n_txt > 0 AND u + u_txt = 1), ' ' ORDER BY col_idx) AS profile,
         sum(n_all - n - n_txt) AS missing
  FROM (SELECT dataset_id, col_idx, "column", count(num) AS n, count(txt) AS n_txt, count(*) AS n_all, min(num) AS lo, max(num) AS hi,
               count(DISTINCT num) AS u, count(DISTINCT txt) AS u_txt FROM cells GROUP BY ALL) GROUP BY dataset_id
), points AS (
  SELECT dataset_id, count(*) FILTER (WHERE kind = 4 AND k > 0 AND v > 0) AS tube, count(*) AS angles FROM m GROUP BY dataset_id
)
SELECT dataset_id, row_count, CAST(4 AS BIGINT) AS column_count, source_array,
       CAST(row_number() OVER (PARTITION BY dataset_id, source_array ORDER BY ord, id) - 1 AS INTEGER) AS position, id, title,
       CASE id WHEN 'raw_statistics' THEN statistics WHEN 'column_profile' THEN profile WHEN 'dataset_overview' THEN concat(row_count, ':4:', missing)
         WHEN 'missing_values_summary' THEN CAST(missing AS VARCHAR) WHEN 'rubensrohr_sound_speed_table' THEN concat('resonance_points:', tube)
         WHEN 'rubensrohr_inverse_frequency_plot' THEN concat('tube_coordinates:', tube)
         WHEN 'rubensrohr_inverse_frequency_regression' THEN concat('tube_coordinates:', tube)
         WHEN 'angle_time_plot' THEN concat('angle_coordinates:', angles)
         WHEN 'rubensrohr_sound_speed_result' THEN
           'n,mean_sound_speed_m_s,sample_std_ddof1_m_s,sem_m_s,min_sound_speed_m_s,max_sound_speed_m_s,source_columns'
         WHEN 'latitude_result' THEN 'not_computable,reason,omega_mess_rad_s,ratio,latitude_deg,correction_factor_used'
         WHEN 'angular_regression' THEN 'x_column,y_column,n,slope,intercept,r_value,r_squared,p_value,stderr'
         WHEN 'gaussian_error_template' THEN 'latex' WHEN 'no_time_angle_regression' THEN 'not_computable,requires_todo'
         WHEN 'xy_tracking_no_angle' THEN 'not_computable,requires_todo'
         ELSE CASE WHEN contains(id, '_column_') THEN 'column' ELSE 'not_computable' END END AS details, true AS whole, true AS has_data
FROM blocks JOIN sizes USING (dataset_id) JOIN described USING (dataset_id) JOIN points USING (dataset_id)""",
        "written_points": f"""
WITH {_MEASURED}
SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY row_idx) - 1 AS position, row_idx, k AS frequency_hz, v AS peak_spacing_m,
       round(2 * v, 6) AS wavelength_m FROM m WHERE kind = 4 AND k > 0 AND v > 0""",
        "written_coordinates": f"""
WITH {_MEASURED}
SELECT dataset_id, 'tube_coordinates' AS plot, CAST(0 AS BIGINT) AS chunk, count(*) AS n, CAST(0 AS BIGINT) AS "offset",
       string_agg(printf('(%.9f,%.9f)', 1 / k, v), ' ' ORDER BY row_idx) AS coordinates FROM m WHERE kind = 4 AND k > 0 AND v > 0 GROUP BY dataset_id
UNION ALL
SELECT dataset_id, 'angle_coordinates', 0, count(*), 0, string_agg(printf('(%.6f,%.6f)', t, v), ' ' ORDER BY row_idx) FROM m WHERE kind < 3 GROUP BY dataset_id""",
        "arrival_statistics": f"""
WITH {_CELLS}
SELECT dataset_id, "column", count(num) AS n, CAST(avg(num) AS FLOAT) AS mean, min(num) AS "min", max(num) AS "max"
FROM cells GROUP BY dataset_id, "column" HAVING count(num) > 0""",
    }
    queries["selected_payloads"] = f"""
WITH {_BLOCKS}, texts(id, description, hint) AS (VALUES {_description_rows()}), chosen AS (
  SELECT b.*, coalesce(x.description, y.description) AS description, coalesce(x.hint, '') AS hint, sizes.n AS n_rows, missing, c."column"
  FROM blocks b LEFT JOIN texts x ON b.id = x.id LEFT JOIN texts y ON starts_with(b.id, y.id || '_column_') OR starts_with(b.id, y.id || '_numeric_column_')
  LEFT JOIN per_column c ON b.dataset_id = c.dataset_id AND b.id IN ('empty_column_' || c."column", 'constant_numeric_column_' || c."column")
  JOIN (SELECT dataset_id, count(*) AS n FROM m GROUP BY dataset_id) sizes ON sizes.dataset_id = b.dataset_id
  JOIN (SELECT dataset_id, sum(n_all - n - n_txt) AS missing FROM per_column GROUP BY dataset_id) g ON g.dataset_id = b.dataset_id
  WHERE b.id IN ('dataset_overview', 'gaussian_error_template') OR source_array = 'warnings'
)
SELECT 'r' || dataset_id AS request_id, 'preferred' AS kind, '{{"experiment_title":"Versuch r' || dataset_id
  || '","experiment_type":null,"lab_notes":null,"metadata":{{}},"summary_for_generation":null,"selected_analysis_blocks":['
  || string_agg(concat('{{"content":{{"data":', CASE WHEN id = 'dataset_overview' THEN concat('{{"columns":4,"missing_values":', missing, ',"rows":', n_rows, '}}')
       WHEN id = 'gaussian_error_template' THEN {_quote(json.dumps({"latex": ERROR_FORMULA}, separators=(",", ":")))}
       WHEN "column" IS NOT NULL THEN concat('{{"column":"', "column", '"}}')
       WHEN id IN ('no_time_angle_regression', 'xy_tracking_no_angle') THEN '{{"not_computable":true,"requires_todo":true}}'
       ELSE '{{"not_computable":true}}' END,
     ',"description":"', description, '","latex_hint":"', hint, '"}},"id":"', id, '","section":"', section, '","source":{{"array":"', source_array,
     '","id":"', id, '"}},"title":"', title, '","type":"', type, '"}}'), ',' ORDER BY block)
  || '],"generation_rules":{{}}}}' AS payload, 0 AS n_warnings
FROM chosen GROUP BY dataset_id"""
    queries["arrival_regression"] = queries["angular_regression"]
    heads = ", ".join(f"({i}, {_quote(h)})" for i, (_, h) in enumerate(RUN_KINDS))
    queries["read_file_lines"] = f"""
SELECT dataset_id, n_lines, n_chars, replace(header, '\\t', chr(9)) AS header
FROM ({queries["read_lines"]}) JOIN (SELECT * FROM (VALUES {heads}) AS h(kind, header)) ON kind = dataset_id % 6"""
    return queries
