import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellumite.functions import geometry as G
from vellumite.operators import aggregates, joins, matching, selection, windows


def random_boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 400), rng.uniform(0, 600)
        w, h = rng.choice([(0, 5), (5, 0), (-3, 4), (30, 8), (120, 90), (10, 200)])
        out.append((i % 3, i, x, y, x + w, y + h))
    return out


def boxed(spark, rows):
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("box", G.box("x0", "y0", "x1", "y1"))


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_pairs_against_brute_force(spark, seed):
    rows = random_boxes(120, seed)
    got = {(r.a_id, r.b_id) for r in joins.overlapping_pairs(boxed(spark, rows), ["page"]).collect()}
    solid = [r for r in rows if r[4] > r[2] and r[5] > r[3]]
    want = {(a[1], b[1]) for a, b in itertools.combinations(sorted(solid, key=lambda r: r[1]), 2) if a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    assert got == want


def test_overlapping_pairs_of_nothing(spark):
    assert joins.overlapping_pairs(boxed(spark, []), ["page"]).count() == 0


def test_matchings_differ(spark):
    c = spark.createDataFrame([("p", "a", "x", 0.9), ("p", "a", "y", 0.5), ("p", "b", "x", 0.8)], "page string, left_id string, right_id string, score double")
    pairs = lambda f: {(r.left_id, r.right_id) for r in f(c, ["page"]).collect()}
    assert pairs(matching.match_most) == {("a", "y"), ("b", "x")}
    assert pairs(matching.match_best) == {("a", "y"), ("b", "x")}
    assert pairs(matching.match_first) == {("a", "x")}


@pytest.mark.parametrize("seed", range(12))
def test_optimal_assignment_against_all_permutations(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 5)
    w = [[rng.choice([0, rng.random()]) for _ in range(m)] for _ in range(n)]
    got = matching.optimal_assignment(w)
    short, long = sorted((range(n), range(m)), key=len)
    sums = [sum(w[i][j] if n <= m else w[j][i] for i, j in zip(short, p, strict=True)) for p in itertools.permutations(long, len(short))]
    assert sum(w[i][j] for i, j in got) == pytest.approx(max(sums))
    assert len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)


@pytest.mark.parametrize("seed", range(12))
def test_maximum_matching_against_brute_force(seed):
    rng = random.Random(seed)
    near = {i: [j for j in range(5) if rng.random() < 0.4] for i in range(5)}
    got = matching.maximum_matching(near, list(near))
    best = 0
    for p in itertools.permutations([*range(5), *[None] * 5], 5):
        best = max(best, sum(j is not None and j in near[i] for i, j in enumerate(p)))
    assert len(got) == best and all(j in near[i] for j, i in got.items())


def test_undefined_rates(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (3, 1, 0)], "tp int, fp int, fn int")
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    rows = df.select(*(v.alias(k) for k, v in aggregates.prf(*c).items()), *(v.alias("f_" + k) for k, v in aggregates.prf_filled(*c).items())).collect()
    assert (rows[0].precision, rows[0].recall, rows[0].f1) == (None, None, None)
    assert (rows[0].f_precision, rows[0].f_recall) == (1.0, 1.0)
    assert (rows[1].f_precision, rows[1].recall) == (0.0, 0.0)
    assert rows[2].f1 == pytest.approx(6 / 7)


def test_error_rate(spark):
    df = spark.createDataFrame([(0, 0, 1), (2, 0, 1), (1, 4, 1), (0, 0, 0)], "e int, r int, p int")
    assert [x.v for x in df.select(aggregates.error_rate(F.col("e"), F.col("r"), F.col("p")).alias("v")).collect()] == [0.0, None, 0.25, None]


def test_null_cell_is_not_an_empty_one(spark):
    t = lambda v: aggregates.table_slots(spark.createDataFrame([("d", [[v, "b"]])], "d string, cells array<array<string>>"), ["d"])
    r = aggregates.slot_counts(t(None), t(""), ["d"]).first()
    assert (r.cell_tp, r.cell_fp, r.cell_fn) == (1, 1, 1)
    assert aggregates.slot_counts(t(None), t(None), ["d"]).first().cell_tp == 2


def test_peak_takes_ends_first(spark):
    s = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 6, 7)], "k string, a int, b int")
    assert windows.peak_concurrency(s, ["k"], "a", "b").first().peak == 2


def test_medians_differ(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 10)], "k string, v double")
    assert aggregates.upper_median(df, ["k"], "v").first()["median"] == 3
    assert aggregates.interpolated_median(df, ["k"], "v").first()["median"] == 2.5
    assert aggregates.exact_rank(df, ["k"], "v", {"p": 0.5}).first().p == 2


def test_weighted_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([("k", 0.9, 2), ("k", 0.8, 1), ("k", 0.8, 1)], "k string, s double, w int")
    assert aggregates.weighted_mode(df, ["k"], "s", "w").first()["mode"] == 0.8


def test_pseudonyms_share_a_person(spark):
    rows = [("d", 1, "Becker", "Names"), ("d", 2, "Thomas Becker", "Names"), ("d", 3, "Ann Moor", "Names"), ("d", 4, "a@b.example", "Email addresses"), ("d", 5, "A@B.example", "Email addresses")]
    f = spark.createDataFrame(rows, "doc string, at int, value string, category string")
    got = {r.value: r.label for r in windows.pseudonyms(f, ["doc"], "at").collect()}
    assert got == {"Thomas Becker": "Person A", "Becker": "Person A", "Ann Moor": "Person B", "a@b.example": "Email 1", "A@B.example": "Email 1"}


def test_islands_and_packing(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 5.0, 10.0), ("p", 0.0, 12.0, 5.0, 14.0), ("p", 0.0, 30.0, 5.0, 31.0)], "page string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.y0, r.y1, r.n) for r in windows.pack(df, ["page"], 3.0).collect()) == [(0.0, 14.0, 2), (30.0, 31.0, 1)]


def test_merged_boxes_reach_further(spark):
    rows = [("p", "a", 0.0, 0.0, 10.0, 10.0), ("p", "b", 20.0, 0.0, 30.0, 10.0), ("p", "c", 5.0, 0.0, 25.0, 5.0), ("p", "d", 100.0, 0.0, 110.0, 5.0)]
    df = spark.createDataFrame(rows, "page string, id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.first_id for r in windows.merged_boxes(df, ["page"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_line_fields(spark):
    df = spark.createDataFrame([(1, "Device: X-1 Owner: Ann Moor (remark)\nsee http://x: y\nName | Ann"), (2, None)], "id int, text string")
    assert [(r.label, r.value) for r in joins.line_fields(df).orderBy("label").collect()] == [("Device", "X-1"), ("Owner", "Ann Moor")]


def test_table_fields(spark):
    form = [("t", r, c, v) for r, row in enumerate([["Name", "Ann"], ["City", "Ulm"]]) for c, v in enumerate(row)]
    data = [("u", r, c, v) for r, row in enumerate([["ID", "Name"], ["1", "Ann"], ["2", "Bob"]]) for c, v in enumerate(row)]
    df = spark.createDataFrame(form + data, "table_id string, row int, column int, text string")
    got = {(r.table_id, r.label, r.value, r.kind) for r in joins.table_fields(df).collect()}
    assert ("t", "City", "Ulm", "row") in got and ("t", "Name", "Ann", "row") in got
    assert ("u", "ID", "1", "column") in got and ("u", "Name", "Bob", "column") in got


@pytest.mark.parametrize("bound", [joins.NAME_BYTES, 0])
def test_names(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "NAME_BYTES", bound)  # 0: as a long list of names
    units = spark.createDataFrame([(1, "Dear Becker, Thomas Becker wrote to becker@x.example; the rose"), (2, "Rose Green saw green"), (3, None)], "id int, text string")
    names = spark.createDataFrame([("Thomas Becker",), ("Becker",), ("Rose Green",)], "name string")
    got = {(r.id, r.name, r.start) for r in joins.name_occurrences(units, names).collect()}
    assert (1, "Becker", 5) in got and (1, "Thomas Becker", 13) in got and len([g for g in got if g[1] == "Becker"]) == 1 and len(got) == 3
    assert {r.word for r in joins.name_words(names, units.select("text")).collect()} == {"Thomas", "Becker"}


def test_lower_words_as_in_java(spark):
    s = "O'brien moor's re-2 re- x_y green Green moor3 'rose a@bee see http://x ünder-way"
    row = spark.createDataFrame([(s,)], "s string").select(F.regexp_extract_all(F.regexp_replace("s", joins.ADDRESS, " "), F.lit(joins.LOWER), F.lit(0)).alias("w")).first()
    assert joins.lower_words(s) == set(row.w)


def test_address_block(spark):
    rows = [(1, "a", 10.0, "12 High Street"), (1, "b", 24.0, "Springfield, IL 62704"), (1, "c", 38.0, "Ann Moor"), (1, "d", 52.0, "Apt 9")]
    df = spark.createDataFrame(rows, "page int, id string, y double, text string").select("page", "id", G.box(F.lit(10.0), F.col("y"), F.lit(90.0), F.col("y") + 12).alias("box"), "text")
    assert {r.id for r in joins.address_block(df.where("id = 'a'").select("page", "id"), df).collect()} == {"b"}


def test_consensus(spark):
    schema = "c array<struct<text:string,score:double,variant:string,model:string>>"
    cases = [
        ([("a b", 0.95, "original", "m"), ("ab", 0.97, "scaled", "m")], ("a b", False, "character_consensus")),
        ([("a", 0.95, "o", "m"), ("b", 0.97, "s", "m")], ("b", True, "character_disagreement")),
        ([("a@b", 0.95, "o", "m"), ("a @b", 0.97, "s", "m")], ("a @b", True, "identifier_disagreement")),
        ([(" ", 0.9, "o", "m")], (" ", True, "empty_recognition")),
    ]
    for c, want in cases:
        assert tuple(spark.createDataFrame([(c,)], schema).select(aggregates.consensus(F.col("c")).alias("s")).first().s) == want


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "w1", "queued", 5), (2, "w1", "queued", 3), (3, "w2", "queued", 1), (4, "w2", "running", 0)], "id int, worker string, status string, created int")
    assert [r.id for r in windows.claim_first(jobs, jobs.where("status = 'running'"), "worker", ["created"]).collect()] == [2]
    with pytest.raises(ValueError):
        selection.stale(jobs, F.current_timestamp(), 10)


def test_upsert_and_import(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, updated int")
    ch = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 9, 1)], "k string, v int, updated int")
    assert {(r.k, r.v) for r in selection.upsert(rows, ch, ["k"]).collect()} == {("a", 3), ("b", 1), ("c", 9)}
    assert {r.k for r in selection.new_only(ch, rows, ["k"]).collect()} == {"c"}


def test_split_dates(spark):
    rows = [("p", "a", 1.0, 1.0, "2024-03-"), ("p", "b", 2.0, 1.0, "18"), ("p", "c", 3.0, 1.0, "2024-02-"), ("p", "d", 4.0, 1.0, "31")]
    df = spark.createDataFrame(rows, "page string, id string, y0 double, x0 double, text string")
    assert [r.value for r in selection.join_split_dates(df, ["page"]).collect()] == ["2024-03-18"]


def test_fingerprint_is_independent_of_order(spark):
    df = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    r = df.select(selection.fingerprint(["a", "b", "c"]).alias("x"), selection.fingerprint(["c", "a", "b"]).alias("y"), selection.canonical_json(["b", "a"]).alias("j")).first()
    assert r.x == r.y and r.j == '{"a":null,"b":1}'
