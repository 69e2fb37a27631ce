"""Searches given as a table, and places of features within a taxon, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labspark.operators import catalog
from labspark.sources.tables import FEATURE_COLUMNS, TAXA_COLUMNS

TEXTS = ["acer", "ACER ", "ac_r", "a%r", "%", "_", "__", "", "x", "Äh", "äh", "rosa 1", "\\b", "zzz", "s%_%1", "____________", "ro", "r", "100%", None]


def like(name, text):
    if name is None:
        return False

    def fold(s):
        return re.sub("[A-Z]", lambda m: m[0].lower(), s)

    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(text))
    return re.search(f"(?s)^.*{pattern}.*$", fold(name)) is not None


@pytest.fixture(scope="module")
def taxa(spark):
    rng = random.Random(8)
    words = ["Acer", "Rosa", "Salix\\b", "ÄHRE", "rubra", "x", "1", "12", "a r", ""]
    rows = []
    for i in range(400):
        name = " ".join(rng.choices(words, k=rng.randrange(4)))
        rows.append((f"t{i:03d}", name, rng.choice([None, "Ahorn", "Rose 1"]), "species", rng.choice(["active", "stub", None]), rng.choice([None, "photo", "exclude_from_identification"]), "f", None))
    rows.append((None, "Acer", None, "species", "active", None, None, None))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TAXA_COLUMNS)).repartition(3)


@pytest.mark.parametrize("stubs", [False, True])
@pytest.mark.parametrize("hot", [1, 4096])
def test_search_table_equals_brute_force(spark, taxa, monkeypatch, stubs, hot):
    monkeypatch.setattr(catalog, "_HOT_GRAMS", hot)
    queries = spark.createDataFrame([(t, 1) for t in TEXTS + TEXTS[:3]], "query string, position int")
    out = catalog.search_table(taxa, queries, stubs, limit=7)
    assert out.columns == ["query", "position", *TAXA_COLUMNS]
    got = sorted((r.query, r.position, r.taxon_id or "") for r in out.collect())
    rows = taxa.collect()
    hidden = {"deprecated", "reference_only", "critical"} | (set() if stubs else {"stub"})
    want = []
    for text in {t.strip() for t in TEXTS if t is not None}:
        ids = sorted(
            r.taxon_id or ""
            for r in rows
            if r.status not in hidden
            and r.app_scope != "exclude_from_identification"
            and (text == "" or any(like(r[c], text) for c in ("scientific_name", "german_name", "taxon_id")))
        )
        want += [(text, i, t) for i, t in enumerate(ids[:7], 1)]
    assert got == sorted(want)


def test_search_table_equals_batch_search(spark, taxa):
    texts = [t for t in TEXTS if t is not None]
    known = taxa.filter("taxon_id is not null")
    table = catalog.search_table(known, spark.createDataFrame([(t,) for t in texts], "query string"))
    batch = catalog.batch_search(known, texts)
    assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_search_table_meets_no_whole_catalog(spark, taxa):
    queries = spark.createDataFrame([("acer",), ("%",)], "query string")
    plan = catalog.search_table(taxa, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = queries.limit(0)
    assert catalog.search_table(taxa, empty).count() == 0 and catalog.search_table(taxa.limit(0), queries).count() == 0


@pytest.mark.parametrize("split_rows", [1, 50, 1 << 20])
def test_places_of_features(spark, split_rows):
    rng = random.Random(3)
    known = spark.createDataFrame([(t, t) for t in ("hot", "small", "bare", "same")], "taxon_id string, scientific_name string")
    rows = [
        (f"f{i}", "hot" if i % 2 else rng.choice(["small", "same"]), rng.choice(["leaf", "bark", None]), rng.choice("ab"), str(i % 5), "s", "high", "high", None)
        for i in range(900)
    ]
    rows += [("same", "same", "leaf", "a", "1", "s", "high", "high", None)] * 200
    owned = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FEATURE_COLUMNS)).repartition(5)
    out = catalog.ranked_details(catalog.taxon_details(known, owned), split_rows).collect()
    assert len(out) == 1101 and [r.position for r in out if r.taxon_id == "bare"] == [None]

    def key(r):
        return [(v is not None, v or "") for v in (r.organ, r.feature_group, r.character, r.feature_id)]

    for taxon in ("hot", "small", "same"):
        mine = sorted((r for r in out if r.taxon_id == taxon), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1)) == list(range(1, mine[0].features_count + 1))
        assert [key(r) for r in mine] == sorted(map(key, mine))


def test_hot_taxon_is_spread(spark):
    known = spark.createDataFrame([("hot",), ("cold",)], "taxon_id string")
    owned = spark.range(20_000).select(
        *[F.lit("x").alias(c) for c in FEATURE_COLUMNS if c not in ("feature_id", "taxon_id")],
        F.col("id").cast("string").alias("feature_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("taxon_id"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ranked = catalog.ranked_details(catalog.taxon_details(known, owned), 1000)
        assert ranked.filter("taxon_id = 'hot'").count() == 10_000
        sizes = [r.n for r in ranked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 3000
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("piece", [3, 50])
def test_runs_of_many_pairs_are_cut_into_pieces(spark, taxa, monkeypatch, piece):
    monkeypatch.setattr(catalog, "_PIECE", piece)
    texts = ["acer", "rosa 1", "ac_r", "a%r", "ro", "r", "rubra", "Acer Rosa", "_", "__________", ""]
    known = taxa.filter("taxon_id is not null")
    table = catalog.search_table(known, spark.createDataFrame([(t,) for t in texts], "query string"))
    batch = catalog.batch_search(known, texts)
    assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
