"""Catalog search, details, photo features and data quality."""

import pytest
from pyspark.sql import functions as F

from labspark.operators import catalog, quality
from labspark.sources.tables import FEATURE_COLUMNS, TAXA_COLUMNS, first_release, read_catalog

STATUSES = ["active", "stub", "context", "structured_paraphrase", "deprecated", "reference_only", "critical", "review", None]


@pytest.fixture(scope="module")
def taxa(spark):
    rows = [
        (f"acer_{i}", f"Acer {s}", "Ahorn", "species", s, None, "Sapindaceae", "Rothmaler.pdf")
        for i, s in enumerate(STATUSES)
    ]
    rows += [
        ("ulmus", "Ulmus ÄHRE", "Ulme", "genus", "active", "exclude_from_identification", "", None),
        ("tilia", "Tilia", "Linde_x", "genus", "active", "a|exclude_from_identification", None, "strasburger"),
        ("festuca_rubra", "Festuca rubra", "Schwingel", "species", "critical", None, "Poaceae", "x"),
        ("salix", "Salix\\b", "Weide", "hybrid", "active", "photo|field", "Salicaceae", ""),
    ]
    rows += [(f"rosa_{i:02d}", f"Rosa {i}", "Rose", "species", "active", None, "Rosaceae", "a") for i in range(51)]
    schema = ", ".join(f"{c} string" for c in TAXA_COLUMNS)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def features(spark):
    rows = [
        ("f1", "acer_0", "leaf", "shape", "lobed", "five", "high", "high", "note"),
        ("f2", "acer_0", "bark", "texture", "rough", "old", "high", "high", None),
        ("f3", "nowhere", "fruit", "colour", "red", "ripe", "high", "high", None),
        ("f4", "tilia", "leaf", "shape", "heart", "oblique", "medium", "medium", None),
    ]
    rows += [(f"r{i}", "rosa_00", "leaf", "edge", "toothed", str(i), "low", "low", None) for i in range(500)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FEATURE_COLUMNS))


def ids(df):
    return sorted(r.taxon_id for r in df.collect())


def test_status_and_scope(taxa):
    standard = ids(catalog.matching_taxa(taxa, "acer"))
    assert standard == ["acer_0", "acer_2", "acer_3", "acer_7", "acer_8"]
    stubs = ids(catalog.matching_taxa(taxa, "acer", include_stubs=True))
    assert stubs == sorted([*standard, "acer_1"])
    assert ids(catalog.matching_taxa(taxa, "ulmus")) == []
    assert ids(catalog.matching_taxa(taxa, "tilia")) == ["tilia"]
    for critical in ("festuca_rubra", "ranunculus_auricomus"):
        assert ids(catalog.matching_taxa(taxa, critical)) == []


def test_like_rules(taxa):
    everything = taxa.withColumns({"status": F.lit("active"), "app_scope": F.lit(None).cast("string")})
    assert ids(catalog.matching_taxa(everything, "ähre")) == []  # only ASCII letters fold
    assert ids(catalog.matching_taxa(everything, "ÄHRe")) == ["ulmus"]
    assert ids(catalog.matching_taxa(everything, "festuca_RUBRA")) == ["festuca_rubra"]
    assert ids(catalog.matching_taxa(everything, "T%a")) == ["acer_3", "acer_6", "festuca_rubra", "tilia"]
    assert ids(catalog.matching_taxa(everything, "x\\b")) == ["salix"]


def test_limit_and_envelope(taxa):
    found = catalog.search_taxa(taxa, " Rosa ").collect()
    assert len(found) == 50 and found[0].taxon_id == "rosa_00"
    envelope = catalog.search_envelope(taxa, "Rosa").first()
    assert (envelope["count"], envelope.maybe_truncated, envelope.total_hits) == (50, True, 51)
    small = catalog.search_envelope(taxa, "acer", True).first()
    assert (small["count"], small.maybe_truncated, small.include_stubs) == (6, False, True)


def test_batch_equals_single_searches(taxa):
    texts = ["acer", "Rosa", "", "nothing", "T%a", " acer "] + [f"rosa_{i:02d}" for i in range(80)]
    batch = {}
    for r in catalog.batch_search(taxa, texts).collect():
        batch.setdefault(r.query, []).append((r.position, r.taxon_id))
    for text in ["acer", "Rosa", "", "T%a", "rosa_79"[:7], "rosa_40"]:
        single = [r.taxon_id for r in catalog.search_taxa(taxa, text).collect()]
        assert [t for _, t in sorted(batch.get(text, []))] == single
    assert "nothing" not in batch


def test_batch_has_no_join(taxa):
    plan = catalog.batch_search(taxa, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_details(taxa, features):
    details = catalog.ordered_details(catalog.taxon_details(taxa, features)).collect()
    acer = [r for r in details if r.taxon_id == "acer_0"]
    assert [r.feature_id for r in acer] == ["f2", "f1"] and acer[0].features_count == 2
    assert [(r.feature_id, r.features_count) for r in details if r.taxon_id == "salix"] == [(None, 0)]
    assert sum(r.taxon_id == "rosa_00" for r in details) == 500
    assert ids(catalog.find_taxon(taxa, " salix ")) == ["salix"]
    assert ids(catalog.find_taxon(taxa, "none")) == []


def test_photo_features(taxa, features):
    photo = catalog.first_photo_features(catalog.photo_features(features, taxa)).collect()
    assert [(r.feature_id, r.scientific_name) for r in photo] == [("f3", None), ("f2", "Acer active"), ("f1", "Acer active")]
    joined = catalog.photo_features(features, taxa)
    assert [r.feature_id for r in catalog.feature_text_filter(joined, "BARK").collect()] == ["f2"]
    assert [r.feature_id for r in catalog.feature_text_filter(joined, "nowhere").collect()] == ["f3"]
    assert catalog.feature_text_filter(joined, " ").count() == 3
    medium = catalog.photo_features(features, taxa, "medium", "medium").collect()
    assert [r.feature_id for r in medium] == ["f4"]


def test_labels(taxa):
    labels = {r.taxon_id: (r.status_label, r.source_label) for r in catalog.with_labels(taxa).collect()}
    assert labels["acer_0"] == ("geprüft", "Rothmaler")
    assert labels["acer_1"][0] == "vorläufig" and labels["acer_7"][0] == "review" and labels["acer_8"][0] == ""
    assert labels["ulmus"][1] == "" and labels["festuca_rubra"][1] == "x" and labels["tilia"][1] == "Strasburger"


def test_quality(spark, taxa, features):
    without = ids(quality.active_without_features(taxa, features))
    assert "acer_0" not in without and "salix" in without and "rosa_00" not in without and len(without) == 52
    assert [(r.taxon_id, r.n_features) for r in quality.dangling_features(taxa, features).collect()] == [("nowhere", 1)]
    release = spark.createDataFrame([("4.0", "production")], "version string, release_stage string")
    checks = quality.catalog_expectations(taxa, release, "Acer", ["festuca_rubra"]).collect()
    assert {r.name: r.passed for r in checks} == dict.fromkeys([r.name for r in checks], True) and len(checks) == 5
    bad = {r.name: r.passed for r in quality.catalog_expectations(taxa, release.limit(0), "zzz", ["tilia"]).collect()}
    assert not bad["standard_search_finds_taxa"] and not bad["release_fields_present"] and not bad["excluded_taxa_not_found"]
    gaps = {r.column: r.n_empty for r in quality.completeness(taxa.filter("rank = 'genus'"), ["rank"], ["family", "status"]).collect()}
    assert gaps == {"family": 2, "status": 0}
    assert {r.tag: r.n for r in quality.scope_tags(taxa).collect()} == {
        "exclude_from_identification": 2,
        "a": 1,
        "photo": 1,
        "field": 1,
    }
    assert ids(quality.awaiting_review(taxa)) == ["acer_7"]


def test_catalog_folder(spark, taxa, features, tmp_path):
    taxa.write.parquet(f"{tmp_path}/taxa")
    features.write.parquet(f"{tmp_path}/features")
    spark.createDataFrame([("4.0", "final")], "version string, release_stage string").write.parquet(f"{tmp_path}/release")
    tables = read_catalog(spark, str(tmp_path))
    assert tables["taxa"].count() == taxa.count() and first_release(tables["release"]).first().version == "4.0"
    photo = catalog.photo_features(tables["features"], tables["taxa"])
    plan = photo._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(visibility_in_photo,high)" in plan and "source_pdf" not in plan


def test_large_taxa_meet_their_features_by_broadcast(spark, monkeypatch, taxa, features):
    def rows(df):
        return sorted(map(str, df.collect()))

    want = rows(catalog.taxon_details(taxa, features))
    monkeypatch.setattr(catalog, "SPLIT_ROWS", 100)
    details = catalog.taxon_details(taxa, features)
    plan = details._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan
    assert rows(details) == want
    ranked = catalog.ranked_details(details, 50).where("taxon_id = 'rosa_00'")
    assert sorted(r.position for r in ranked.collect()) == list(range(1, 501))
