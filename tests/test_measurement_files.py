"""Fourteen measurement files with different headers, analysed together in one run."""

import json
import math

import pytest
from pyspark.sql import functions as F

from labspark.plans.analysis import analyse
from labspark.sources import delimited
from labspark.sources.lines import empty_files, read_files, read_lines, split_lines

# Contents of measurement files and the numbers they lead to.
FILES = {
    "D1": "time,angle\n0,0\n1,2\n2,4\n3,6\n",
    "D2": "time,angle\n0,0\n1,2\n2,4\n3,6\n",
    "D3": "time,x,y\n0,1,0\n1,0,1\n2,-1,0\n",
    "D4": "",
    "D5": 'time,angle\n0,"unterminated',
    "D6": "time;angle\n0;0,0\n1;2,0\n2;4,0\n",
    "D7": "frequency_Hz,peak_spacing_m\n300,0.572\n350,0.490\n400,0.429\n450,0.381\n500,0.343\n550,0.312\n600,0.286\n",
    "D8": "a,b,label\n1,2,low\n2,4,mid\n3,6,high\n",
    "D9": "height,width\n1,4\n2,5\n3,6\n",
    "D10": "a,label1,label2\n1,x,y\n2,z,w\n",
    "D11": "a\n1,5\n2,5\n",
    "D12": "a,b\n1,2,3\n4,5,6\n",
    "D13": "a,b\nNA,1\n,2\nnull,3\n-,4\n ,5\n",
    "D14": "frequency_Hz,peak_spacing_m\n300,0.5\n300,0.6\n",
    "quoted": '"a,1";"b ""q"""\r\n"x;y";2\r\n\r\n3;"4"\r\n',
    "names": "x,x,,x\n1,2,3\n",
    "radian": "t\tphi\n0\t0\n1\t0,00001\n2\t0,00002\n",
    "blank_first": "\n   \ntime,angle\n0,1\n1,3\n",
}


@pytest.fixture(scope="module")
def lines(spark):
    return split_lines(spark.createDataFrame(list(FILES.items()), "dataset_id string, content string"))


@pytest.fixture(scope="module")
def result(spark, lines):
    metadata = spark.createDataFrame(
        [
            ("D2", {"omega_mess_rad_s": "999.0", "mass": "5", "calibration": "0"}),
            ("radian", {"angle_unit": "RAD"}),
        ],
        "dataset_id string, metadata map<string,string>",
    )
    return analyse(lines, metadata)


@pytest.fixture(scope="module")
def items(result):
    found = {}
    for r in result.items.collect():
        found.setdefault(r.dataset_id, {})[r.id] = json.loads(r.data) if r.data else None
    return found


def test_layouts(result, rows_of):
    layouts = rows_of(result.layouts, "dataset_id")
    assert layouts["D6"].delimiter == ";" and layouts["D6"].score == 20
    assert layouts["D10"].delimiter == "," and layouts["D10"].score == -4
    assert not layouts["D10"].ref_accepts and layouts["D8"].ref_accepts
    assert layouts["D11"].delimiter is None and layouts["D11"].names == ["a"]
    assert layouts["quoted"].names == ["a,1", 'b "q"']
    assert layouts["names"].names == ["x", "x.1", "Unnamed: 2", "x.2"]
    assert layouts["blank_first"].names == ["time", "angle"]


def test_errors(result, rows_of):
    errors = rows_of(result.errors, "dataset_id")
    assert {k: v.reason for k, v in errors.items()} == {
        "D4": "empty",
        "D5": "unterminated_quote",
        "D12": "row_overflow",
    }
    assert "CSV" in errors["D5"].error and "Leere" in errors["D4"].error


def test_statistics(result, rows_of):
    stats = rows_of(result.statistics, "dataset_id", "column")
    assert math.isclose(stats["D1", "angle"].sample_std, 2.58198889747, rel_tol=1e-9)
    assert stats["D6", "angle"].n == 3 and stats["D6", "angle"].mean == 2.0
    assert stats["D11", "a"].min == 1.5 and stats["D11", "a"].max == 2.5
    assert ("D8", "label") not in stats


def test_profile(result, rows_of):
    profile = rows_of(result.profile, "dataset_id", "column")
    a = profile["D13", "a"]
    assert (a.inferred_type, a.missing_count, a.text_count, a.unique_count) == ("text", 3, 2, 2)
    assert profile["D14", "frequency_Hz"].is_constant
    assert profile["names", "x.2"].inferred_type == "empty"
    assert profile["D8", "label"].inferred_type == "text"


def test_distinct_values_are_typed_like_the_column(spark):
    files = [("n", "v\n1\n1.0\n2\n"), ("t", "v\n1\n1.0\nx\n"), ("c", "v\tw\n1,0\t1\n1,00\t1\n")]
    table = split_lines(spark.createDataFrame(files, "dataset_id string, content string"))
    profile = {(r.dataset_id, r.column): r for r in analyse(table, materialise=False).profile.collect()}
    assert profile["n", "v"].unique_count == 2
    assert profile["t", "v"].unique_count == 3 and profile["t", "v"].inferred_type == "mixed"
    assert profile["c", "v"].unique_count == 2 and profile["c", "v"].inferred_type == "numeric"


def test_overview_and_missing(result, rows_of):
    overview = rows_of(result.overview, "dataset_id")
    assert overview["D1"].row_count == 4 and overview["D3"].column_count == 3
    assert overview["D8"].detected_numeric_columns == ["a", "b"]
    missing = rows_of(result.missing, "dataset_id")
    assert missing["D13"].missing_values_per_column == {"a": 3, "b": 0}
    assert missing["D13"].total_missing_values == 3


def test_regression_and_latitude(result, rows_of):
    fits = rows_of(result.regression, "dataset_id")
    assert math.isclose(fits["D1"].slope, 2.0, rel_tol=1e-12)
    assert math.isclose(fits["D6"].slope, 2.0, rel_tol=1e-12)
    assert "D3" not in fits
    latitude = rows_of(result.latitude, "dataset_id")
    assert latitude["D2"].not_computable and latitude["D2"].omega_mess_rad_s == 999.0
    assert latitude["D2"].correction_factor_used is False
    assert latitude["D1"].not_computable and "Winkeleinheit" in latitude["D1"].reason
    expected = math.degrees(math.asin(1e-5 / 7.2921159e-5))
    assert math.isclose(latitude["radian"].latitude_deg, expected, rel_tol=1e-9)


def test_resonance(result, rows_of):
    tube = rows_of(result.resonance, "dataset_id")
    d7 = tube["D7"]
    want = {
        "speed_mean": 343.1,
        "speed_sample_std": 0.12909944487,
        "speed_sem": 0.04879500365,
        "speed_min": 342.9,
        "speed_max": 343.2,
        "slope": 171.58199274789,
        "slope_stderr": 0.11296601885,
        "r_squared": 0.9999978326887,
    }
    for name, value in want.items():
        assert math.isclose(d7[name], value, rel_tol=1e-9), name
    assert math.isclose(d7.intercept, -7.482469401e-05, rel_tol=1e-8)
    assert math.isclose(d7.intercept_stderr, 2.718779216e-04, rel_tol=1e-8)
    # leading term of the tail of Student's t with five degrees of freedom, t = slope / error
    density = math.gamma(3) / (math.sqrt(5 * math.pi) * math.gamma(2.5))
    tail = 2 * density * 5**2 / (d7.slope / d7.slope_stderr) ** 5
    assert math.isclose(d7.p_value, tail, rel_tol=1e-4)
    assert tube["D14"].n == 2 and tube["D14"].slope is None and tube["D14"].speed_mean == 330.0
    assert result.resonance_points.filter("dataset_id = 'D7'").count() == 7


def test_items(items):
    assert items["D1"]["angular_regression"]["slope"] == 2.0
    assert items["D7"]["rubensrohr_sound_speed_result"]["source_columns"]["frequency_Hz"] == "frequency_Hz"
    assert "rubensrohr_sound_speed_table" in items["D7"] and "rubensrohr_inverse_frequency_plot" in items["D7"]
    assert "rubensrohr_sound_speed_result" not in items["D8"]
    assert items["D3"]["xy_tracking_no_angle"] == {"not_computable": True, "requires_todo": True}
    assert "angular_regression" not in items["D3"] and "latitude_result" not in items["D3"]
    assert "ambiguous_physical_interpretation" in items["D9"]
    assert "rubensrohr_no_variation" in items["D14"]
    assert items["D8"]["dataset_overview"] == {"rows": 3, "columns": 3, "missing_values": 0}
    missing = {k for k in items["D2"] if k.startswith("missing_") and k != "missing_values_summary"}
    assert missing == {
        "missing_calibration",
        "missing_pendulum_length",
        "missing_frame_rate",
        "missing_device_parameters",
    }
    assert len([k for k in items["names"] if k.startswith("empty_column_")]) == 1


def test_preview_blocks_and_reports(result):
    blocks = result.preview_blocks.filter("dataset_id = 'D1'").orderBy("block").collect()
    assert [b.section for b in blocks] == sorted(
        (b.section for b in blocks),
        key=["Tabellen", "Abbildungen", "Messergebnisse", "Rechnungen", "Warnungen"].index,
    )
    assert all(b.id and b.type and b.title and b.content and b.source for b in blocks)
    report = json.loads(result.reports.filter("dataset_id = 'D1'").first().report)
    assert report["used_all_rows"] and report["row_count"] == 4
    assert len(report["preview_blocks"]) == len(blocks)
    summary = json.loads(report["summary_for_generation"])
    assert summary["detected_numeric_columns"] == ["time", "angle"]


def test_forbidden_term_in_a_column_name_rejects_the_summary(spark):
    table = split_lines(
        spark.createDataFrame([("f", "proxy,b\n1,2\n")], "dataset_id string, content string")
    )
    summary = analyse(table, materialise=False).summary.first()
    assert summary.summary is None and "Provenienz" in summary.error


def test_blocks_and_partitions_do_not_change_results(lines, result):
    def table(df):
        return sorted(map(str, df.collect()))

    layouts = table(delimited.detect(lines))
    assert table(delimited.detect(lines.repartition(17), block_rows=2)) == layouts
    assert table(delimited.detect(lines.repartition(1))) == layouts
    cells = delimited.to_cells(
        delimited.parse_rows(lines, delimited.accepted(result.layouts), block_rows=1)
    )
    whole = delimited.to_cells(delimited.parse_rows(lines, delimited.accepted(result.layouts)))
    assert table(cells) == table(whole)


def test_number_rule(spark):
    from labspark.functions.numeric import as_number

    texts = ["1,5", "1.234,5", "inf", "-Infinity", "0x10", "1_000", "1d", "1.0f", "True", " 7 ", "+.5e1", "1.", "NaN"]
    texts += ["", "1e999", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", as_number(F.col("t")).alias("n")).orderBy("i").collect()]
    inf = math.inf
    assert got == [1.5, None, inf, -inf, None, None, None, None, None, 7.0, 5.0, 1.0, None, None, inf, None]


def test_files_read_by_line_and_whole_agree(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / f"{name}.csv").write_text(content, encoding="utf-8", newline="")
    long = "t,v\n" + "".join(f"{i},{i * 2}\n" for i in range(5000))
    (tmp_path / "long.csv").write_text(long)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        by_line = read_lines(spark, str(tmp_path)).withColumn(
            "dataset_id", F.regexp_extract("dataset_id", r"([^/]+)\.csv$", 1)
        )
        long_rows = by_line.filter("dataset_id = 'long'").orderBy("row_idx").collect()
        assert [r.line for r in long_rows] == long.splitlines()
        assert len({r.row_idx for r in long_rows}) == 5001
        split = by_line.rdd.getNumPartitions()
        assert split > 8
        columns = ["dataset_id", "delimiter", "names", "score", "reason"]
        got = sorted(map(str, delimited.detect(by_line).select(columns).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = split_lines(read_files(spark, str(tmp_path))).withColumn(
        "dataset_id", F.regexp_extract("dataset_id", r"([^/]+)\.csv$", 1)
    )
    want = [
        str(r) for r in delimited.detect(whole).select(columns).collect() if r.dataset_id != "D4"
    ]
    assert got == sorted(want)
    assert [r.dataset_id.split("/")[-1] for r in empty_files(spark, str(tmp_path)).collect()] == ["D4.csv"]


def test_write(result, spark, tmp_path):
    result.write(str(tmp_path), "json", ["items", "reports", "errors"])
    back = spark.read.json(f"{tmp_path}/items")
    assert back.filter("source_array = 'tables' and dataset_id = 'D1'").count() == 2
    assert spark.read.json(f"{tmp_path}/errors").count() == 3
