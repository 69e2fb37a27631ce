"""Slices of samples that arrive in parts, against the slices of all of them at once."""

import math

import pytest
from pyspark.sql import functions as F

from labspark.operators import pendulum
from labspark.streaming.arrival import arrival_tables, at_once
from labspark.streaming.slices import late_samples, read_slices, slice_arrivals

SCHEMA = "dataset_id string, row_idx long, t double, x double, y double"


def trace(name, start, stop):
    rows = []
    for i in range(start, stop):
        t = i * 2.5
        swing = 50 * math.cos(t * 1.8)
        rows.append((name, i, t, swing * math.cos(t / 900), swing * math.sin(t / 900) + 0.1 * (i % 7)))
    return rows


@pytest.fixture
def landing(spark, tmp_path):
    folder, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"

    def deliver(rows, files=2):
        spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        slice_arrivals(stream, out, progress, lateness="5 minutes").awaitTermination()

    return folder, out, deliver


def table_of(rows):
    return {(r.dataset_id, r.slice): (r.n, pytest.approx(r.alpha_deg, abs=1e-9)) for r in rows}


def test_equal_to_the_slices_of_all_samples(spark, landing):
    folder, out, deliver = landing
    a, b = trace("a", 0, 1000), trace("b", 0, 1000)
    # A slice is split between two parts, and some samples come late, but within the limit.
    deliver([r for r in a + b if r[1] < 500 and not 450 <= r[1] < 470])
    deliver([r for r in a + b if r[1] >= 500 or 450 <= r[1] < 470])
    samples = spark.read.schema(SCHEMA).parquet(folder)
    assert table_of(read_slices(spark, out).collect()) == table_of(pendulum.slice_angles(samples).collect())
    assert read_slices(spark, out).count() == 42
    assert late_samples(samples, out).count() == 0


def test_late_samples_are_counted(spark, landing):
    folder, out, deliver = landing
    rows = trace("a", 0, 1000)
    held = [r for r in rows if r[1] < 96 and r[1] % 3 == 0]
    deliver([r for r in rows if r not in held])
    deliver([(None, 1, 2600.0, 1.0, 2.0), ("c", 1, 1.0, 1.0, 1.0), ("a", 5000, None, 1.0, 1.0), ("a", 5001, math.nan, 1.0, 1.0), *held])
    on_time = spark.createDataFrame([r for r in rows if r not in held], SCHEMA)
    assert table_of(read_slices(spark, out).collect()) == table_of(pendulum.slice_angles(on_time).collect())
    late = late_samples(spark.read.schema(SCHEMA).parquet(folder), out).collect()
    assert sorted((r.dataset_id, r.slice, r.n_late) for r in late) == [("a", 0, 16), ("a", 1, 16), ("c", 0, 1)]


def test_samples_without_values_and_an_empty_part(spark, landing):
    folder, out, deliver = landing
    deliver([("a", 1, None, 1.0, 1.0)])
    deliver([("a", 2, 0.0, None, 1.0), ("a", 3, 1.0, 1.0, 2.0), ("a", 4, 2.0, 2.0, 4.0), ("a", 5, -1.0, 0.0, 0.0)])
    got = read_slices(spark, out).collect()
    assert [(r.slice, r.n) for r in got] == [(0, 2)] and got[0].alpha_deg == pytest.approx(math.degrees(math.atan(2)))
    samples = spark.read.schema(SCHEMA).parquet(folder).filter(F.col("t").isNotNull())
    assert late_samples(samples, out).count() == 0


def test_lines_of_a_batch_are_read_once_for_all_tables(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("f", 0, "time,angle"), ("f", 1, "0,1"), ("f", 2, "1,3"), ("f", 3, "2,5.5")]
    lines = spark.createDataFrame(rows, "dataset_id string, row_idx long, line string").mapInArrow(counted, "dataset_id string, row_idx long, line string")
    made = arrival_tables(lines)
    assert made["regression"].count() == 1 and made["statistics"].count() == 2 and read.value == len(rows)


def test_work_at_once_raises_what_failed(spark):
    done = []

    def work(name):
        if name == "b":
            raise ValueError(name)
        done.append(name)

    with pytest.raises(ValueError):
        at_once(spark, work, ["a", "b", "c"])
    assert sorted(done) == ["a", "c"]
