"""Quoted cells over several lines, against a reader that goes through a text character by character."""

import random

import pytest
from pyspark.sql import functions as F

from labspark.plans.analysis import analyse
from labspark.sources import delimited
from labspark.sources.lines import split_lines
from labspark.sources.records import joined_records


def read_sequentially(text, delimiter):
    """([(first line, cells)], whether the last record stays open)."""
    records, cells, cell, state, begin = [], [], "", "start", 0
    for number, line in enumerate(text.split("\n")):
        if state == "quoted":
            cell += "\n"
        else:
            cells, cell, state, begin = [], "", "start", number
        for c in line:
            if state == "quoted":
                if c == '"':
                    state = "quote"
                else:
                    cell += c
            elif state == "quote" and c == '"':
                cell, state = cell + '"', "quoted"
            elif c == delimiter:
                cells, cell, state = [*cells, cell], "", "start"
            elif state == "start" and c == '"':
                state = "quoted"
            else:
                cell, state = cell + c, "bare"
        if state != "quoted":
            records.append((begin, [*cells, cell]))
    return records, state == "quoted"


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
@pytest.mark.parametrize("delimiter", [",", "\t", None])
def test_records_equal_a_sequential_reader(spark, block_rows, delimiter):
    rng = random.Random(f"{block_rows}{delimiter}")
    rows = [("".join(rng.choices(['"', delimiter or ";", "a", "\n", ""], [3, 2, 2, 2, 1], k=rng.randrange(30)))) for _ in range(300)]
    files = spark.createDataFrame(list(enumerate(rows)), "dataset_id long, content string")
    lines = split_lines(files).withColumn("row_idx", F.col("row_idx") * 7).withColumn("delimiter", F.lit(delimiter).cast("string")).repartition(5)
    out = joined_records(lines, delimited.DELIMITERS, block_rows * 7)
    fields = delimited.split_fields(F.col("line"), F.col("delimiter"))
    found = {}
    for r in out.select("dataset_id", "row_idx", "unclosed", fields.alias("fields")).collect():
        found.setdefault(r.dataset_id, []).append((r.row_idx // 7, r.fields, r.unclosed))
    joined = 0
    for i, text in enumerate(rows):
        want, open_ = read_sequentially(text, delimiter)
        got = sorted(found[i])
        if open_:
            assert [g[0] for g in got] == list(range(text.count("\n") + 1)) and all(g[2] for g in got)
        else:
            assert [g[:2] for g in got] == want and not any(g[2] for g in got)
            joined += len(want) < text.count("\n") + 1
    assert joined > 10


FILES = {
    "cells": 'a,"no\nte",c\n1,"x\n\ny, ""z""\n",3\n\n2,plain,4\n5,"",6\n',
    "open": 'a,b\n1,"x\n2,y\n',
    "header": '"only\nname"\n1\n2\n',
    "header_open": 'a;"b\n1;2\n',
    "semicolon": 'a;b\n"1;\n2";3\n"4";"5\n6"\n',
    "long": 'a,b\n1,"' + 'x ""y""\n' * 30_000 + '"\n2,z\n',
}


@pytest.mark.parametrize("block_rows", [2, 1 << 20])
def test_files_with_multiline_cells(spark, rows_of, block_rows):
    lines = split_lines(spark.createDataFrame(list(FILES.items()), "dataset_id string, content string"))
    layouts = delimited.detect(lines, block_rows)
    known = rows_of(layouts, "dataset_id")
    assert known["cells"].names == ["a", "no\nte", "c"] and known["cells"].multiline
    assert known["open"].reason == "unterminated_quote" and known["header_open"].error is not None
    assert known["header"].names == ["only\nname"] and known["semicolon"].names == ["a", "b"]
    rows = delimited.parse_rows(lines, delimited.accepted(layouts), block_rows=block_rows)
    fields = {}
    for r in rows.orderBy("row_idx").collect():
        fields.setdefault(r.dataset_id, []).append(r.fields)
    assert fields["cells"] == [["1", 'x\n\ny, "z"\n', "3"], ["2", "plain", "4"], ["5", "", "6"]]
    assert fields["semicolon"] == [["1;\n2", "3"], ["4", "5\n6"]]
    assert fields["header"] == [["1"], ["2"]]
    assert fields["long"] == [["1", 'x "y"\n' * 30_000], ["2", "z"]]


def test_analysis_of_multiline_files(spark, rows_of):
    text = 't,note,v\n0,"a\nb",1\n1,"c",3\n2,"d\n\ne",5\n'
    lines = split_lines(spark.createDataFrame([("f", text), ("g", "t,v\n0,1\n1,2\n")], "dataset_id string, content string"))
    overview = rows_of(analyse(lines, block_rows=2).overview, "dataset_id")
    assert (overview["f"].row_count, overview["f"].detected_numeric_columns) == (3, ["t", "v"])
    assert overview["g"].row_count == 2


def test_plain_files_need_no_assembly(spark):
    lines = split_lines(spark.createDataFrame([("f", 'a,b\n1,"x"\n')], "dataset_id string, content string"))
    layouts = delimited.detect(lines)
    plan = delimited.parse_rows(lines, delimited.accepted(layouts))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def exchanges_of(plan, column):
    """Exchanges that move the column, each counted once."""
    own = plan.nodeName() == "Exchange" and f"{column}#" in plan.output().mkString(",")
    children = plan.children()
    return own + sum(exchanges_of(children.apply(i), column) for i in range(children.size()))


def test_lines_are_moved_once(spark):
    lines = split_lines(spark.createDataFrame(list(FILES.items()), "dataset_id string, content string")).withColumn("delimiter", F.lit(","))
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        plan = joined_records(lines, delimited.DELIMITERS, 100)._jdf.queryExecution().executedPlan()
        assert exchanges_of(plan, "line") == 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
