import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumite.functions import geometry as G
from vellumite.functions import integrity as I  # noqa: E741
from vellumite.functions import pii, predicates
from vellumite.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize("s, want", [("DE89 3704 0044 0532 0130 00", True), ("DE89 3704 0044 0532 0130 01", False), ("GB82WEST12345698765432", True), ("DE89", False)])
def test_iban(spark, s, want):
    assert one(spark, pii.iban_valid(F.col("s")), s=s) is want
    assert (pii.iban_at(re.match(".*", s)) == s) is want


@pytest.mark.parametrize("s, want", [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("0000 0000 0000 0000", False)])
def test_luhn_needs_two_digits(spark, s, want):
    assert one(spark, pii.luhn_valid(F.col("s")), s=s) is want


def test_find_gives_spans_and_rules():
    s = "Mail a.b@c.example, phone +1 (499) 555-6503, due 2024-03-18 10:30; api_key: abcdefg1234; IBAN DE89 3704 0044 0532 0130 00 AB12"
    got = {(f["category"], f["value"]) for f in pii.find(s, set(predicates.CATEGORIES))}
    assert ("Email addresses", "a.b@c.example") in got
    assert ("Phone numbers", "+1 (499) 555-6503") in got
    assert ("Bank accounts", "DE89 3704 0044 0532 0130 00") in got
    assert ("Identifiers", "abcdefg1234") in got
    assert not any("2024" in v for c, v in got if c == "Phone numbers")
    for f in pii.find(s, set(predicates.CATEGORIES)):
        assert all(s[p["start"] : p["end"]] == f["value"] for p in f["spans"])
    assert pii.find(None, {"Names"}) == [] and pii.find("", {"Names"}) == []


def test_native_and_arrow_forms_agree(spark):
    s = "x DE89 3704 0044 0532 0130 00 AB12 y 4111-1111-1111-1111 z 10.0.0.300 8.8.8.8"
    row = spark.createDataFrame([(s,)], "s string").select(pii.ibans(F.col("s")).alias("i"), pii.cards(F.col("s")).alias("c"), pii.ipv4s(F.col("s")).alias("p")).first()
    assert row.i == ["DE89 3704 0044 0532 0130 00"] and row.c == ["4111-1111-1111-1111"] and row.p == ["8.8.8.8"]


def test_literal_spans():
    assert pii.literal_spans("Ann  Moor and Ann Moore", "Ann Moor") == [(0, 9)]
    assert pii.literal_spans("mail d.lee@corp.example.", "d.lee@corp.example") == [(5, 23)]
    assert pii.literal_spans("정시우에게", "정시우") == [(0, 3)]
    assert pii.literal_spans("EMP-0012", "EMP-001") == []
    assert pii.literal_spans("a", "") == []


def test_mask_longest_first(spark):
    df = spark.createDataFrame([("Ann Moor, Ann", ["Ann", "Ann Moor"])], "s string, v array<string>")
    assert df.select(pii.mask("s", "v").alias("m")).first().m == "[REDACTED], [REDACTED]"
    runs = spark.createDataFrame([(["Ann ", "Moor", " x"], ["Ann Moor"])], "s array<string>, v array<string>")
    assert runs.select(pii.mask_runs("s", "v").alias("m")).first().m == ["[REDACTED]", "", " x"]


@pytest.mark.parametrize("s, want", [("Full name:", True), ("No.", True), ("This is a whole sentence.", False), ("Employee ID)", False), ("Phone 2", False), ("a/b", False), ("", False), ("one two three four five six seven", False)])
def test_label_like(spark, s, want):
    assert one(spark, predicates.label_like(F.col("s")), s=s) is want
    assert predicates.reads_as_label(s) is want


@pytest.mark.parametrize("v, c, want", [("API key", "Identifiers", False), ("EMP-12", "Identifiers", True), ("Ann 2", "Names", False), ("2024-01-02", "Identifiers", False), ("2024-01-02", "Dates of birth", True)])
def test_plausible(spark, v, c, want):
    assert one(spark, predicates.plausible(F.col("v"), F.col("c")), v=v, c=c) is want


@pytest.mark.parametrize("v, want", [("+1 499\n555 6503", True), ("12\n34\n56", False), ("2019 2020 2021", False), ("499 555-6503", True)])
def test_phone_shape(spark, v, want):
    assert one(spark, predicates.phone_shape(F.col("v")), v=v) is want


def test_normalisers_differ(spark):
    s = "Stra­ße  ﬁ X"
    row = spark.createDataFrame([(s,)], "s string").select(T.normalize(F.col("s")).alias("n"), T.compact(F.col("s")).alias("c"), T.score_compact(F.col("s")).alias("k")).first()
    assert row.n == "Stra­ße fi X" and row.c == "StraßeﬁX" and row.k == "strassefix"


def test_edit_counts_prefer_the_diagonal(spark):
    assert T.edit_counts("abc", "axc") == (1, 0, 0)
    assert T.edit_counts("abc", "ac") == (0, 0, 1)
    assert T.edit_counts("", "ab") == (0, 2, 0)
    row = spark.createDataFrame([("a b c", "a x c d")], "a string, b string").select(T.word_edit_counts("a", "b").alias("e")).first().e
    assert tuple(row) == (1, 1, 0)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_edit_counts_sum_to_the_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    assert sum(T.edit_counts(a, b)) == d[-1]


def test_fields_and_contents_lines(spark):
    f = spark.createDataFrame([("Full name: Ann Moor",), ("12: x",), ("see: http://x",)], "s string").select(T.split_field(F.col("s")).alias("f")).collect()
    assert tuple(f[0].f) == ("Full name", "Ann Moor") and f[1].f is None
    t = spark.createDataFrame([("Intro ..... 12",), ("No leader",)], "s string").select(T.toc_split(F.col("s")).alias("t")).collect()
    assert (t[0].t.title, t[0].t.tail) == ("Intro", "12") and t[1].t is None


def test_value_match(spark):
    df = spark.createDataFrame([("Ann Moor", "x ann moor"), ("Ann Moor", "Ann Mo"), ("Ann Moor", "A"), ("", "x")], "e string, v string")
    assert [r.m for r in df.select(T.value_match(F.col("e"), F.col("v")).alias("m")).collect()] == ["full", "partial", None, None]


def test_boxes(spark):
    df = spark.range(1).select(G.box(0, 0, 10, 10).alias("a"), G.box(5, 5, 15, 15).alias("b"), G.box(10, 0, 5, 5).alias("bad"))
    a, b = F.col("a"), F.col("b")
    r = df.select(G.iou(a, b).alias("iou"), G.fraction_of_first(a, b).alias("f"), G.clip(b, F.lit(12), F.lit(4)).alias("gone"), G.flip(b, F.lit(20)).alias("flip"), G.iou_clamped(a, F.col("bad")).alias("clamped"), G.coverage(F.array(a, b), b).alias("cover"), G.fitting_scales(F.lit(0.88)).alias("scales")).first()
    assert r.iou == pytest.approx(25 / 175) and r.f == 0.25 and r.gone is None and tuple(r.flip) == (5, 5, 15, 15)
    assert r.clamped == 0 and r.cover == 1.0 and r.scales == [1.0, 0.95, 0.9, 0.88]


# --- integrity ---


def test_tokens_go_out_and_come_back():
    s = "Call 12 or a@b.example on 2024-03-18 at 10:30, code HR-2024, USD 1,234.50"
    text, tokens = I.protect(s)
    assert all(v not in text for v in ("a@b.example", "2024-03-18", "HR-2024"))
    assert I.restore(text, tokens) == s
    with pytest.raises(ValueError):
        I.restore(text.replace(next(iter(tokens)), ""), tokens)
    damaged = next(iter(tokens))
    assert I.restore(text.replace(damaged, damaged[5:]), tokens) == s


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="{}"), max_size=40))
def test_protect_round_trip(s):
    text, tokens = I.protect(s)
    assert I.restore(text, tokens) == s


@pytest.mark.parametrize(
    "source, target, want",
    [
        ("Total 12", "Summe 12", None),
        ("Total 12", "Summe 13", "literals"),
        ("three consecutive quarters", "3 Quartale in Folge", None),
        ("about five percent more", "etwa 5% mehr", None),
        ("Due in March", "3월 마감", None),
        ("11월 마감", "Due in November", None),
        ("Employee ID: X-12 Email: a@b.example", "Employee ID: a@b.example Email: X-12", "bindings"),
        ("Thi", "Sure, please provide the text that you would like me to translate, and I will", "far_longer"),
        ("Page count is 12", "12", "prose_gone"),
        ("Short label", "Short\nlabel", "lines_added"),
        ("x", I.MARK + "00000000N0E", "token_left"),
        ("twelve", "12", None),
    ],
)
def test_first_fault(source, target, want):
    assert I.first_fault(source, target) == want


def test_number_words():
    assert I.number_words("two hundred and five thousand three") == Counter({205003: 1})
    assert I.ordinal_words("the twenty-first and the third") == Counter({21: 1, 3: 1})
    assert I.ordinal_numbers("1st 2nd 3rd 4th 11th 12st") == Counter({1: 1, 2: 1, 3: 1, 4: 1, 11: 1})
    assert I.months("May and March, you may go in May") == [3, 5]


def test_segments_lose_nothing():
    s = "Sentence one. " * 400 + "2024-03-18 " * 30
    parts = I.segments(s)
    assert "".join(parts) == s and max(map(len, parts)) <= 1500
    assert not any(p.endswith("2024-03-") for p in parts)
    with pytest.raises(ValueError):
        I.segments("x " * 40000)


def test_terms():
    assert I.replace_terms("The Widget and WIDGET, widgets", {"widget": "gadget"}) == "The Gadget and GADGET, widgets"
    assert I.required_terms("data science lab", {"data science": "a", "science": "b", "lab": "c"}) == {"data science": "a", "lab": "c"}


def test_multiset_difference(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(1)).alias("x"), F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(1)).alias("y"))
    assert df.select(I.multiset_difference(F.col("x"), F.col("y")).alias("d")).first().d == {"a": 2, "b": 1}


def test_job_rules(spark):
    df = spark.createDataFrame([('{"mode":"pii"}',), ('{"mode":"x"}',), ('{"other":1}',), ("[1]",)], "o string")
    assert [r.e for r in df.select(predicates.option_error(F.col("o")).alias("e")).collect()] == [None, "BAD_MODE", "UNKNOWN_OPTION", "NOT_AN_OBJECT"]


def test_limit_and_filter_order(spark):
    item = lambda page: (page, 0.1, 0.1, 0.1, 0.1, "masked", "whole_line")
    df = spark.createDataFrame([([item(9), item(1), item(1)],)], "i array<struct<page:int,x:double,y:double,width:double,height:double,state:string,reason:string>>")
    r = df.select(F.size(predicates.review_items(F.col("i"), F.lit(3), 2)).alias("a"), F.size(predicates.review_items_of_first(F.col("i"), F.lit(3), 2)).alias("b")).first()
    assert (r.a, r.b) == (2, 1)


def test_addresses_by_label(spark):
    df = spark.createDataFrame([([["Home address", " 12 High Street, Springfield "], ["Name", "Ann"], ["Address"]], "Postal Address: 7, Low Road, Ulm\nAddress book:\nx"), (None, None)], "c array<array<string>>, t string")
    rows = df.select(pii.labelled_addresses(F.col("c"), F.col("t")).alias("a")).withColumn("l", pii.address_literals(F.col("a"))).collect()
    assert rows[0].a == ["12 High Street, Springfield", "7, Low Road, Ulm"] and rows[1].a == [] and rows[1].l == []
    assert rows[0].l == ["12 High Street, Springfield", "7, Low Road, Ulm", "12 High Street", "7, Low Road", "Springfield"]


@pytest.mark.parametrize("source, target, want", [("Name: a Age: b", "Nom: a\nAge: b", "Nom: a Age: b"), ("N: a | M: b", "X: a\nY: b", "X: a | Y: b"), ("N: a | M: b", "X: a |\n Y: b", "X: a | Y: b"), ("N: a", "X: a\nnote", "X: a\nnote"), ("N: a | M: b", "X: a\nY b", "X: a\nY b")])
def test_field_layout(source, target, want):
    assert I.field_layout(source, target) == want


@pytest.mark.parametrize("s, want", [("{v1} The end.", "The end."), ("1.2 {v1} The end. {v2}", "The end."), ("{v1} and more", None), ("In {v1} it is.", None), ("Done. {v1}{v2}", "Done."), ("{v1}", None)])
def test_edge_placeholders(s, want):
    span = I.edge_placeholders(s)
    assert (s[span[0] : span[1]] if span else None) == want


def test_terms_of_a_glossary(spark):
    assert I.acceptable_term("List price", "Preis") and not I.acceptable_term("Part 7", "Teil 8") and not I.acceptable_term("x", "a\nb") and not I.acceptable_term("x", "")
    df = spark.createDataFrame([("ThinkPad", "ThinkPad"), ("Status", "Status"), ("12", "12"), ("Ann Moor", "Ann Moor"), ("X1", "Y1")], "s string, t string")
    assert [r.k for r in df.select(predicates.kept_unchanged(F.col("s"), F.col("t")).alias("k")).collect()] == [True, False, False, True, False]
    df = spark.createDataFrame([("ThinkPad X1",), ("MacBook 14",), ("plain words",), ("X1 $20",), ("a b c d X1",)], "s string")
    assert [r.k for r in df.select(predicates.is_product_name(F.col("s")).alias("k")).collect()] == [True, True, False, False, False]
