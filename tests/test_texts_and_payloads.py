"""Protocol texts, payload scrubbing, block selection and arrival."""

import json
import os

import pytest
from pyspark.sql import functions as F

from labspark.functions.text import clean_generated_text
from labspark.operators import documents, payload, report
from labspark.sources.lines import split_lines
from labspark.sources.tables import payload_schema, read_bibliographies, read_protocols
from labspark.streaming import arrival
from labspark.streaming.arrival import analyse_arrivals, arrival_tables, read_arrivals, stream_files

FENCED = "```latex\n\\documentclass{article}\n% Beleg mit \\cite[S.~X]{key}\nText \\cite{known2020}.\n"
BROKEN = (
    "\\documentclass{article} %TODO\nDer Wert ist geschätzt, 50\\% sicher \\cite[Gl.~7, S.~7]{known2020, lost1999}, "
    "siehe known2020. \\printbibliography\n\\end{document}\n"
)
GOOD = "Text \\cite{known2020} ohne Fehler.\n\\printbibliography\n\\end{document}\n"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("T1", FENCED), ("T2", BROKEN), ("T3", GOOD)], "doc_id string, tex string")
    bib = spark.createDataFrame(
        [(d, "book", k) for d in ("T1", "T2", "T3") for k in ("known2020", "spare2001")],
        "doc_id string, entry_type string, key string",
    )
    return docs, bib


def test_violations(corpus):
    docs, bib = corpus
    found = {}
    for r in documents.violations(docs, bib).collect():
        found.setdefault(r.doc_id, []).append((r.rule_id, r.severity, r.detail))
    assert found["T1"] == [("bibliography_missing", "error", None)]
    assert sorted(found["T2"]) == [
        ("citation_literal", "error", "known2020"),
        ("citation_missing", "error", "lost1999"),
        ("estimate_guessed", "warning", None),
        ("todo", "warning", None),
    ]
    assert "T3" not in found


def test_quality_report(corpus):
    report_rows = {r.doc_id: (r.n_errors, r.n_warnings, r.passed) for r in documents.quality_report(*corpus).collect()}
    assert report_rows == {"T1": (1, 0, False), "T2": (2, 2, False), "T3": (0, 0, True)}


def test_placement_and_internal_terms(spark):
    texts = [
        ("a", "x \\printbibliography y \\end{document}"),
        ("b", "TODOS PL   Generator, SHA256 \\printbibliography \\end{document}"),
        ("c", "Ein typischerweise\nbeträgt, plausibler Wert \\printbibliography\\end{document}"),
    ]
    found = {}
    for r in documents.violations(spark.createDataFrame(texts, "doc_id string, tex string")).collect():
        found.setdefault(r.doc_id, set()).add(r.rule_id)
    assert found == {
        "a": {"bibliography_misplaced"},
        "b": {"internal_pl_generator", "internal_sha256"},
        "c": {"estimate_typical", "estimate_plausible"},
    }


def test_citations(corpus):
    docs, bib = corpus
    cited = documents.citations(docs)
    assert {(r.doc_id, r.key) for r in documents.missing_citations(cited, bib).collect()} == {("T2", "lost1999")}
    assert {r.key for r in documents.uncited_entries(cited, bib).collect()} == {"spare2001"}
    shared = documents.missing_citations(cited, bib, per_document=False).collect()
    assert [(r.key, r.n_docs) for r in shared] == [("lost1999", 1)]


def test_forbidden_terms(spark):
    df = spark.createDataFrame([(1, "ein PROXY und codex"), (2, "nichts")], "id int, text string")
    found = {(r.id, r.term) for r in documents.forbidden_terms(df, "id", "text").collect()}
    assert found == {(1, "Proxy"), (1, "Codex")}


def test_clean_text(spark):
    texts = ["```LaTeX\n\\documentclass{a}\n```\n", "Hier: \\documentclass{a} ", "\\documentclass{a}", "``` x", FENCED]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.select("i", clean_generated_text(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got[:4] == ["\\documentclass{a}"] * 3 + ["x"]
    assert got[4].startswith("\\documentclass{article}") and not got[4].endswith("\n")


def test_corpus_from_files(spark, tmp_path):
    folder = tmp_path / "2026-pendel"
    folder.mkdir()
    (folder / "protokoll.tex").write_text(GOOD, encoding="utf-8")
    (folder / "literatur.bib").write_text(
        "@string{jan = {Januar}}\n@book{known2020,\n title={x}, note={a@b.de}\n}\n@Article{ \n spare2001 ,\n}\n@comment{no,}\n"
        "@misc{müller2020,}\n", encoding="utf-8")
    docs = read_protocols(spark, f"{tmp_path}/*/*.tex")
    bib = read_bibliographies(spark, f"{tmp_path}/*/*.bib")
    assert [(r.doc_id.split("/")[-1], r.tex) for r in docs.collect()] == [("2026-pendel", GOOD)]
    assert {(r.entry_type, r.key) for r in bib.collect()} == {
        ("book", "known2020"),
        ("article", "spare2001"),
        ("misc", "müller2020"),
    }
    assert documents.quality_report(docs, bib).first().passed


def test_citation_commands_comments_and_unicode_keys(spark):
    texts = {
        "bib": r"\parencite{lost1999} \cites[S.~1]{a}[2]{b, c} \Textcite*{known2020} \nocite{known2020}",
        "all": r"\nocite{*} müller2020 steht hier",
        "lines": "x \\\\% \\cite{ghost}\n100\\% \\cite{real}\n% \\printbibliography \\end{document}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, tex string")
    bib = spark.createDataFrame([(d, k) for d in texts for k in ("known2020", "müller2020")], "doc_id string, key string")
    found = {(r.doc_id, r.rule_id, r.detail) for r in documents.violations(docs, bib).collect()}
    missing = {(d, k) for d, rule, k in found if rule == "citation_missing"}
    assert missing == {("bib", "lost1999"), ("bib", "a"), ("bib", "b"), ("bib", "c"), ("lines", "real")}
    assert {(d, k) for d, rule, k in found if rule == "citation_literal"} == {("all", "müller2020")}
    assert ("lines", "bibliography_missing", None) in found
    cited = documents.citations(docs)
    left = {(r.doc_id, r.key) for r in documents.uncited_entries(cited, bib).collect()}
    assert left == {("bib", "müller2020"), ("lines", "known2020"), ("lines", "müller2020")}
    assert documents.uncited_entries(cited, bib, per_document=False).count() == 0


RAW = {
    "experiment_title": "Test",
    "summary_for_generation": {"row_count": 2, "note": None},
    "selected_analysis_blocks": [{"id": "x", "content": {"csv": "a,b\n1,2", "v": 1}}, {"id": "y"}, {"csv": None}],
    "raw_csv": "a,b",
    "csv": "c,d",
    "file_content": {"deep": ["secret"]},
}


def _keys(node):
    if isinstance(node, dict):
        return set(node) | set().union(*map(_keys, node.values())) if node else set()
    return set().union(*map(_keys, node)) if isinstance(node, list) and node else set()


def test_open_json_scrub(spark):
    texts = [json.dumps(RAW), "no json", None, "[1, {\"csv\": 2}]", '{"csv": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    rows = payload.scrub_open(df, "p", "c").orderBy("i").collect()
    clean = json.loads(rows[0].c.json)
    assert not _keys(clean) & set(payload.RAW_KEYS)
    assert clean["selected_analysis_blocks"] == [{"id": "x", "content": {"v": 1}}, {"id": "y"}, {}]
    assert clean["summary_for_generation"] == {"row_count": 2, "note": None}
    assert sorted(rows[0].c.warnings) == sorted(
        payload.REMOVED + p
        for p in (
            "selected_analysis_blocks[].content.csv",
            "selected_analysis_blocks[].csv",
            "raw_csv",
            "csv",
            "file_content",
        )
    )
    assert rows[1].c.json is None and rows[1].c.error == payload.NOT_JSON
    assert rows[2].c.json is None and rows[2].c.error is None
    assert json.loads(rows[3].c.json) == [1, {}] and json.loads(rows[4].c.json) == {}


def test_odd_json_does_not_stop_the_others(spark):
    deep = "[" * 30 + "]" * 30
    texts = ['{"csv": null, "a": {"raw_csv": null, "b": null}}', '{"t": "\\ud800"}', deep, "{mass: 5", "null", "[" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    rows = [r.c for r in payload.scrub_open(df, "p", "c").orderBy("i").collect()]
    assert json.loads(rows[0].json) == {"a": {"b": None}}
    assert rows[0].warnings == [payload.REMOVED + "a.raw_csv", payload.REMOVED + "csv"]
    assert rows[1].error is None and rows[4].json == "null"
    assert [rows[i].error for i in (2, 3, 5)] == [None, payload.NOT_JSON, payload.NOT_JSON]
    assert rows[2].json == deep and all(rows[i].json is None for i in (3, 5))
    broken = payload.assemble_payloads(_requests(spark, {"request_id": "r", "experiment_title": "t", "metadata": "{mass: 5"}))
    assert broken.first().payload is None and broken.first().error == payload.NOT_JSON


def test_open_json_of_any_depth_is_scrubbed(spark):
    def nested(levels):
        inner = {"csv": 1, "deepest": levels}
        for k in range(levels):
            inner = {"a": inner, "raw_csv": k, "k": k} if k % 2 else [inner, {"b": [k]}]
        return inner

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in payload.RAW_KEYS}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def paths(x, path=""):
        if isinstance(x, list):
            return [p for v in x for p in paths(v, f"{path}[]")]
        found = []
        for key in sorted(x) if isinstance(x, dict) else ():
            here = f"{path}.{key}" if path else key
            found += [here] if key in payload.RAW_KEYS else paths(x[key], here)
        return found

    whole = [nested(n) for n in (1, 5, 6, 7, 8, 9, 10, 13)]
    whole.append([nested(9), nested(3), {"x": nested(8), "csv": nested(12)}, nested(9)])
    rows = [(i, json.dumps(x)) for i, x in enumerate([*whole, whole[-2]])] + [(90, None), (91, "{")]
    got = {r.i: r for r in payload.scrub_open(spark.createDataFrame(rows, "i int, p string"), "p").select("i", "clean.*").collect()}
    assert len(got) == len(rows)
    for i, x in enumerate([*whole, whole[-2]]):
        assert json.loads(got[i].json) == clean(x) and got[i].error is None
        assert got[i].warnings == [payload.REMOVED + p for p in paths(x)]
    assert got[90].json is None and got[90].error is None and got[91].error == payload.NOT_JSON
    built = payload.assemble_payloads(_requests(spark, {"request_id": "r", "messages": rows[7][1]})).first()
    assert json.loads(built.payload) == clean(whole[7]) and built.error is None


def test_typed_scrub_and_audit(spark):
    df = spark.createDataFrame([(1, json.dumps(RAW)), (2, '{"experiment_title": "ok"}')], "i int, payload string")
    schema = payload_schema(df)
    rows = {r.i: json.loads(r.payload) for r in payload.scrub_payloads(df, "payload", schema).collect()}
    assert not _keys(rows[1]) & set(payload.RAW_KEYS)
    assert rows[1]["selected_analysis_blocks"][0]["content"]["v"] == 1
    assert rows[1]["summary_for_generation"]["row_count"] == 2 and rows[2]["experiment_title"] == "ok"
    audit = payload.audit(df, "i", F.from_json("payload", schema), schema)
    assert {(r.i, r.path, r.n) for r in audit.collect()} == {
        (1, "selected_analysis_blocks[].content.csv", 1),
        (1, "raw_csv", 1),
        (1, "csv", 1),
        (1, "file_content", 1),
    }


def test_maps_are_scrubbed_and_audited(spark):
    df = spark.sql("SELECT 1 AS i, struct(map('csv', map('a', 1), 'keep', map('raw_csv', 2, 'b', 3)) AS m) AS p")
    kind = df.schema["p"].dataType
    assert df.select(payload.scrub(F.col("p"), kind).alias("p")).first().p.m == {"keep": {"b": 3}}
    found = {(r.path, r.n) for r in payload.audit(df, "i", F.col("p"), kind).collect()}
    assert found == {("m.csv", 1), ("m.keep.raw_csv", 1)}


def _requests(spark, *rows):
    names = ["request_id", "system", "messages", *payload.PREFERRED_FIELDS, *payload.RAW_KEYS]
    filled = [tuple({**dict.fromkeys(names), **r}[n] for n in names) for r in rows]
    return spark.createDataFrame(filled, ", ".join(f"{n} string" for n in names))


def test_assemble(spark):
    requests = _requests(
        spark,
        {
            "request_id": "full",
            "experiment_title": 'Ruben "s" rohr',
            "lab_notes": "Zeile\nzwei",
            "summary_for_generation": '{"row_count": 2}',
            "selected_analysis_blocks": '[{"id": "x", "content": {"csv": "a,b"}}]',
            "generation_rules": "{}",
            "raw_csv": "a,b\n1,2",
            "file_content": "",
        },
        {"request_id": "plain", "messages": '[{"role": "user", "csv": "x"}]', "metadata": "{}", "system": "S"},
        {"request_id": "none", "messages": "[]", "experiment_title": ""},
    )
    rows = {r.request_id: r for r in payload.assemble_payloads(requests).collect()}
    full = json.loads(rows["full"].payload)
    assert list(full) == list(payload.PREFERRED_FIELDS)
    assert full["experiment_title"] == 'Ruben "s" rohr' and full["lab_notes"] == "Zeile\nzwei"
    assert full["metadata"] == {} and full["experiment_type"] is None
    assert full["selected_analysis_blocks"] == [{"id": "x", "content": {}}]
    assert rows["full"].kind == "preferred" and rows["full"].system == payload.DEFAULT_SYSTEM
    assert rows["full"].warnings == [
        payload.REMOVED + p for p in ("raw_csv", "file_content", "selected_analysis_blocks[].content.csv")
    ]
    assert rows["plain"].kind == "messages" and json.loads(rows["plain"].payload) == [{"role": "user"}]
    assert rows["plain"].system == "S"
    assert rows["none"].payload is None and rows["none"].error == payload.REJECTED


def test_clean_request_has_no_warning(spark):
    row = {"request_id": "r", "experiment_title": "t", "generation_rules": '{"missing_values": "write %TODO"}'}
    assert payload.assemble_payloads(_requests(spark, row)).first().warnings == []


def test_block_fallbacks_and_selection(spark):
    rows = [
        ("d", "warnings", 1, None, None, None, None, True, False, None, None),
        ("d", "tables", 1, "t", "", "", "text", False, False, "[]", ""),
        ("d", "results", 1, "r", "result", "R", "text", False, True, "{}", ""),
    ]
    schema = (
        "dataset_id string, source_array string, ord int, id string, type string, title string, description string, "
        "include_default boolean, essential boolean, data string, latex_hint string"
    )
    blocks = report.preview_blocks(spark.createDataFrame(rows, schema))
    got = [(b.id, b.type, b.section, b.title) for b in blocks.orderBy("block").collect()]
    assert got == [
        ("t", "table", "Tabellen", "t"),
        ("r", "result", "Messergebnisse", "R"),
        ("warnings_3", "warning", "Warnungen", "warnings_3"),
    ]
    chosen = report.select_blocks(blocks, report.default_selection(blocks))
    assert sorted(b.id for b in chosen.collect()) == ["r", "warnings_3"]


def test_arrival_equals_batch_and_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        analyse_arrivals(stream_files(spark, str(landing), max_files=2), out, progress).awaitTermination()

    for i in range(3):
        (landing / f"f{i}.csv").write_text(f"t,v\n0,{i}\n1,{i * 2}\n")
    run()
    (landing / "bad.csv").write_text("a,b\n1,2,3\n")
    (landing / "late.csv").write_text("a;b\n1,5;2\n")
    run()
    run()
    stats = read_arrivals(spark, out, "statistics")
    got = sorted((r.dataset_id.split("/")[-1], r.column, r.n, r.mean) for r in stats.collect())
    files = [(p.name, p.read_text()) for p in sorted(landing.iterdir())]
    batch = arrival_tables(split_lines(spark.createDataFrame(files, "dataset_id string, content string")))
    want = sorted((r.dataset_id, r.column, r.n, r.mean) for r in batch["statistics"].collect())
    assert got == want and len(got) == 8
    assert read_arrivals(spark, out, "errors").count() == 1
    fits = {r.dataset_id.split("/")[-1]: r.report for r in read_arrivals(spark, out, "reports").collect()}
    assert {k: json.loads(v) for k, v in fits.items()} == {r.dataset_id: json.loads(r.report) for r in batch["reports"].collect()}


def test_a_batch_that_fails_before_its_commit_is_not_seen_and_tried_again(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = stream_files(spark, str(landing), max_files=1)
        analyse_arrivals(stream, out, progress, lambda lines: {"lines": lines}).awaitTermination()

    (landing / "first.csv").write_text("a,b\n1,2")
    run()
    (landing / "second.csv").write_text("a,b\n3,4")
    with monkeypatch.context() as broken:
        broken.setattr(arrival, "_commit", lambda *args: 1 / 0)
        with pytest.raises(Exception):
            run()
    # The rows of the second file are in folders of failed attempts, but no reader takes them.
    assert spark.read.parquet(f"{out}/lines").count() > 2
    assert {r.line for r in read_arrivals(spark, out, "lines").collect()} == {"a,b", "1,2"}
    run()
    assert sorted(r.line for r in read_arrivals(spark, out, "lines").collect()) == ["1,2", "3,4", "a,b", "a,b"]
    assert spark.read.parquet(f"{out}/lines").count() > 4


def test_a_file_delivered_again_replaces_the_earlier_one(spark, tmp_path):
    out, progress, landing = str(tmp_path / "out"), str(tmp_path / "progress"), tmp_path / "landing"

    def deliver(day, name, text, age):
        folder = landing / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def run():
        stream = stream_files(spark, f"{landing}/*", name=lambda path: F.regexp_extract(path, "([^/]+)$", 1))
        analyse_arrivals(stream, out, progress).awaitTermination()
        rows = read_arrivals(spark, out, "statistics").filter("column = 'v'").collect()
        return sorted((r.dataset_id, r.n, r.mean) for r in rows)

    deliver("1", "a.csv", "t,v\n0,1\n1,3\n", 0)
    deliver("1", "b.csv", "t,v\n0,5\n", 0)
    deliver("2", "b.csv", "t,v\n0,7\n", 10)  # two versions in one batch
    assert run() == [("a.csv", 2, 2.0), ("b.csv", 1, 7.0)]
    deliver("3", "a.csv", "t,v\n0,10\n", 20)
    deliver("3", "b.csv", "t,v\n0,6\n", 5)  # older than what is there
    assert run() == [("a.csv", 1, 10.0), ("b.csv", 1, 7.0)]
    assert run() == [("a.csv", 1, 10.0), ("b.csv", 1, 7.0)]
    assert read_arrivals(spark, out, "statistics", latest=False).filter("column = 'v'").count() == 4


@pytest.mark.parametrize("block_rows", [1, 5, 1 << 20])
def test_entries_open_only_outside_all_braces(spark, tmp_path, block_rows):
    texts = {
        "a": '@string{x = "y"}\n@Book{one,\n title = {A {B @misc{no, z}} C},\n note = "@article{quoted, x}"}\n mail me @ home\n@ misc {two}\n@misc\n{\n three ,}',
        "b": "}} stray @book{four, t={}}\n@comment{ @book{hidden, x={y}} }@preamble{p}@BOOK{five,}",
        "c": "@book{open, t = {never closed @misc{inner, x}",
        "d": "",
        "e": "no entry at all",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bib").write_text(text)
    many = "".join(f"@misc{{k{i}, t = {{a}}, u = {{@book{{no{i}, x}}}}}}\n" for i in range(500))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bib").write_text(many)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        found = {}
        for r in read_bibliographies(spark, f"{tmp_path}/*/*.bib", block_rows).collect():
            found.setdefault(r.doc_id.split("/")[-1], []).append((r.entry_type, r.key))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(found["a"]) == [("book", "one"), ("misc", "three")]
    assert sorted(found["b"]) == [("book", "five"), ("book", "four")]
    assert found["c"] == [("book", "open")] and "d" not in found and "e" not in found
    assert sorted(found["f"]) == sorted(("misc", f"k{i}") for i in range(500))


def test_rows_that_the_merged_schema_cannot_tell(spark):
    """Nulls instead of objects, several types under one key, escaped keys, raw fields in raw fields, odd names."""
    whole = [
        {"a": {"csv": 1, "b": 2}, "n": 1, "we ird`k, VOID": {"raw_csv": None, "x": "y"}, "AVOID": None, "OBJECT": {}},
        {"a": None, "n": {"csv": [1, {"csv": 2}], "keep": None}},
        {"a": [{"csv": 1}, 3, None], "n": "text with \"csv\": inside"},
        {"a": {"b": {"file_content": 1, "z": []}}, "n": [[{"raw_csv": 1}]]},
        {"a": {}, "n": True},
        [{"csv": 1}, {"k": 2.50}, None, [{"csv": {}}]],
        [],
        3,
        "csv",
        None,
    ]
    texts = [json.dumps(x) for x in whole] + ['{"n": {"\\u0063sv": 1, "m": 2}}', ' \n{"a": {"csv": 1}}']
    whole += [{"n": {"csv": 1, "m": 2}}, {"a": {"csv": 1}}]

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in payload.RAW_KEYS}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def paths(x, path=""):
        if isinstance(x, list):
            return [p for v in x for p in paths(v, f"{path}[]")]
        found = []
        for key in sorted(x) if isinstance(x, dict) else ():
            here = f"{path}.{key}" if path else key
            found += [here] if key in payload.RAW_KEYS else paths(x[key], here)
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    for frame in (df, df.filter("i != 2"), df.filter("i in (0, 5, 11)")):
        rows = payload.scrub_open(frame, "p", "c").collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert json.loads(r.c.json) == clean(whole[r.i]) and r.c.error is None
            assert sorted(r.c.warnings) == sorted(payload.REMOVED + p for p in paths(whole[r.i]))
    assert payload.scrub_open(df.limit(0), "p").count() == 0


def test_payloads_with_many_keys_take_the_long_way(spark, monkeypatch):
    monkeypatch.setattr(payload, "MOST_FIELDS", 3)
    texts = [json.dumps({f"k{i}": {"csv": i, "v": i}}) for i in range(6)]
    rows = payload.scrub_open(spark.createDataFrame(list(enumerate(texts)), "i int, p string"), "p", "c").collect()
    assert all(json.loads(r.c.json) == {f"k{r.i}": {"v": r.i}} and r.c.warnings == [payload.REMOVED + f"k{r.i}.csv"] for r in rows)


def test_literal_keys_equal_words_of_the_text(spark):
    import random

    import regex

    rng = random.Random(6)
    keys = ["a", "b:c", "x.y", ".a", "a.", "\\E", "ä", "a+b", "", "-", "c"]
    pieces = ["a", "b:c", "x.y", "ä", "a+b", " ", ".", "-", "(", "\\E", "A", "\n", "_", "c", "/", "é", "1"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, keys) for i, t in enumerate(texts)], "i int, tex string, keys array<string>")
    found = {r.i: set(r.k) for r in df.select("i", documents.standing_keys(F.col("tex"), F.col("keys")).alias("k")).collect()}
    for i, text in enumerate(texts):
        words = {w.strip(".:+/-") for w in regex.split(r"[^\p{L}\p{M}\p{N}_:.+/-]+", text)} - {""}
        assert found[i] == words & set(keys), text
    assert sum(map(bool, found.values())) > 100
