import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumite.functions import predicates
from vellumite.plans import evaluation, privacy, providers
from vellumite.sources import documents, files
from vellumite.sources.html import cells_of
from vellumite.sources.schema import CONTENT, PREDICTION, REFERENCE
from vellumite.streaming import jobs

BOX = [0.0, 0.0, 10.0, 10.0]


def test_text_regions(spark):
    unit = {"id": "p1", "kind": "page", "number": 1, "width": 100.0, "height": 100.0, "regions": [
        {"id": "r1", "kind": "text", "bbox": BOX, "text": "Hello", "cells": None, "metadata": None},
        {"id": "t1", "kind": "table", "bbox": BOX, "text": None, "cells": [["H1", "H2"], ["", "x"]], "metadata": None}]}
    df = spark.createDataFrame([("d", "0.1.0", "pdf", "a" * 64, "native", [], [unit])], CONTENT)
    rows = {r.region_id: r for r in documents.text_regions(df).collect()}
    assert set(rows) == {"r1", "t1:r0:c0", "t1:r0:c1", "t1:r1:c1"}
    assert rows["t1:r1:c1"].column_header == "H2" and rows["t1:r1:c1"].row_values == ["", "x"] and rows["r1"].table_parent is None


def reference(sha, text="one two", tables=(), figures=()):
    page = (1, 100.0, 100.0, 0, ["text", "tables", "figures"], text, list(tables), list(figures))
    return (sha, sha, "top-left displayed-page points", True, "me", [page])


def prediction(sha, regions):
    return (sha, sha, "native", "1", "{}", "top-left displayed-page points", [(1, 100.0, 100.0, 0, regions)])


def test_evaluation(spark):
    table = ("t", BOX, [["a", "b"], [None, "d"]])
    refs = spark.createDataFrame([reference("a" * 64, tables=[table], figures=[("f", [50.0, 50.0, 60.0, 60.0])]), reference("b" * 64)], REFERENCE)
    preds = spark.createDataFrame([prediction("a" * 64, [("x", "text", [20.0, 20.0, 30.0, 30.0], "one  tvo", None), ("y", "table", BOX, None, [["a", "b"], [None, "X"]])])], PREDICTION)
    rows = {r.source_sha256[0]: r for r in evaluation.evaluate(refs, preds).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.character_errors, a.reference_characters, a.word_errors, a.reference_words) == (1, 7, 1, 2)
    assert (a.tables_tp, a.tables_fp, a.tables_fn, a.cell_tp, a.cell_fp, a.cell_fn, a.table_dimensions_correct) == (1, 0, 0, 3, 1, 1, 1)
    assert (a.figures_tp, a.figures_fn) == (0, 1) and a.missing_prediction is False
    assert b.missing_prediction is True and b.word_errors == 2
    assert evaluation.invalid(preds).count() == 0
    with pytest.raises(ValueError):
        evaluation.guard(refs, preds.union(preds))
    with pytest.raises(ValueError):
        evaluation.guard(refs.where("source_name like 'b%'"), preds)


def test_detection_and_masks(spark):
    units = spark.createDataFrame([("d", "r1", "Dear Thomas Becker, mail t.b@x.example"), ("d", "r2", "Becker: EMP-77"), ("d", "h", "Staff number")], "doc_id string, region_id string, text string")
    pairs = spark.createDataFrame([("d", "r2", "Staff number", "EMP-77", "inline"), ("d", "r1", "Due", "2024-01-02", "inline")], "doc_id string, region_id string, label string, value string, kind string")
    decisions = spark.createDataFrame([("Staff number", "Identifiers"), ("Due", "Identifiers")], "label string, category string")
    names = spark.createDataFrame([("Thomas Becker",)], "name string")
    found, suppressed = privacy.detect_document(units, pairs, decisions, names, predicates.CATEGORIES)
    got = {(r.region_id, r.value, r.category, r.method) for r in found.collect()}
    assert got == {("r1", "Thomas Becker", "Names", "document_name_sweep"), ("r1", "t.b@x.example", "Email addresses", "pattern"), ("r2", "EMP-77", "Identifiers", "field_label"), ("r2", "Becker", "Names", "name_variant")}
    assert suppressed.count() == 0
    masked = {r.region_id: r.text for r in privacy.mask_units(units, found).collect()}
    assert masked["r1"] == "Dear [REDACTED], mail [REDACTED]" and masked["r2"] == "[REDACTED]: [REDACTED]" and masked["h"] == "Staff number"
    hide, keep = privacy.split_kept(found, ["Thomas Becker, Ulm"])
    assert {r.value for r in keep.collect()} == {"Thomas Becker", "Becker"} and hide.count() == 2


def test_column_headers_overrule_a_model_only(spark):
    pairs = spark.createDataFrame([("d", "c1", "Article", "A-1", "column"), ("d", "c2", "Note", "B-2", "inline")], "doc_id string, region_id string, label string, value string, kind string")
    decisions = spark.createDataFrame([("Article", "none"), ("Note", "none")], "label string, category string")
    f = spark.createDataFrame([("d", "c1", "A-1", "Identifiers", "model_proposal"), ("d", "c2", "B-2", "Identifiers", "model_proposal"), ("d", "c1", "A-1", "Identifiers", "pattern")], "doc_id string, region_id string, value string, category string, method string")
    assert [(r.value, r.method) for r in privacy.overruled(f, pairs, decisions).collect()] == [("A-1", "model_proposal")]


def test_answers_need_the_text(spark):
    units = spark.createDataFrame([("r1", "Ann Moor, 2024-01-02"), ("r2", "x")], "region_id string, text string")
    answer = lambda *f: json.dumps({"findings": [{"category": c, "value": v} for c, v in f]})
    a = spark.createDataFrame([("r1", answer(("Names", "Ann Moor"), ("Identifiers", "2024-01-02"))), ("r2", answer(("Names", "Bob"))), ("r2", "no json")], "region_id string, answer string")
    rows = privacy.valid_proposals(a, units, predicates.CATEGORIES).collect()
    assert sorted(r.valid for r in rows) == [False, False, True]
    assert [f.value for r in rows if r.valid for f in r.findings] == ["Ann Moor"]


def test_equal_requests_go_out_once(spark):
    calls = []

    def provider(requests):
        calls.append(requests.count())
        return providers.offline(requests)

    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    assert providers.asked_once(rows, "t", provider).where("answer is not null").count() == 3 and calls == [2]


def test_final_check(spark):
    df = spark.createDataFrame([(1, 100.0, 200.0, BOX, "Ann", "Names"), (1, 0.0, 0.0, BOX, "Bob", "Names"), (1, 100.0, 200.0, BOX, "Kept", "Names")], "page int, width double, height double, b array<double>, value string, category string")
    from vellumite.functions import geometry as G

    areas, lost = privacy.final_check(df.withColumn("box", G.from_array(F.col("b"))), ["kept"])
    assert [(r.x, r.y, r.width, r.height) for r in areas.collect()] == [(0.0, 0.0, 0.11, 0.055)]
    assert [r.value for r in lost.collect()] == ["Bob"]


def test_html_tables():
    assert cells_of("<table><tr><th>A</th><td colspan=2> b </td></tr></table>") == [(0, 0, 0, "A", True, False), (0, 0, 1, "b", False, True)]
    assert cells_of(None) == [] and cells_of("<p>x") == []


def test_packages(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no package")
    rows = files.read_packages(spark, str(tmp_path)).orderBy("path", "place").collect()
    assert [(r.kind, r.text, r.cells) for r in rows[:2]] == [("text", "Hello", None), ("table", None, [["a"]])] and rows[2].kind == "error"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":')
    assert sorted(r.a for r in files.read_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    df = spark.createDataFrame([(1,)], "a int")
    files.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        files.write_once(df, str(tmp_path / "out"))
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Pages")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    got = {r.filename: r.error for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got["x.pdf"] is None and got["y.pdf"] == "NOT_PDF" and got["a.jsonl"] == "FILENAME"


def test_cache_computes_what_is_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("k", F.upper("k").alias("v"))

    path = str(tmp_path / "cache")
    files.cached(spark, spark.createDataFrame([("a",), ("b",)], "k string"), "k", path, compute).count()
    out = files.cached(spark, spark.createDataFrame([("b",), ("c",)], "k string"), "k", path, compute)
    assert seen == [2, 1] and {(r.k, r.v) for r in out.collect()} == {("b", "B"), ("c", "C")}


def test_streams_agree_with_batches(spark, tmp_path):
    from vellumite.operators import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    got = {r.event_id for r in jobs.drain(jobs.debounced(stream, 3600), "debounced").collect()}
    want = {r.event_id for r in windows.debounced(events, ["user_id"], "ts", "event_type", 3600).collect()}
    assert got == want
    once = jobs.drain(jobs.without_replays(jobs.read_events(spark, str(tmp_path / "in")), ["event_id"]), "once")
    assert once.count() == events.count()
    last = jobs.drain(jobs.latest_heartbeat(jobs.read_events(spark, str(tmp_path / "in"))), "last", "complete")
    assert last.count() == events.select("user_id").distinct().count()
