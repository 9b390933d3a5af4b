"""Normalisers and string functions. Built-in expressions where Spark has them; Arrow UDFs for Unicode tables only."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import wraps
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode white space, as Python's str.isspace() has it.
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def arrow(kind: str):
    """An Arrow UDF that is made when it is first applied: its type needs a session, importing this does not."""

    def of(f):
        @wraps(f)
        def apply(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return apply

    return of


def _text_udf(f, kind="string"):
    @arrow(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


#: NFKC and one space for each run of white space; case kept.
normalize = _text_udf(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()))
#: Full case folding, which lower() is not (ß becomes ss).
casefold = _text_udf(str.casefold)
nfc = _text_udf(lambda s: unicodedata.normalize("NFC", s))
#: Arabic presentation forms to their letters, all else as it is.
fold_presentation = _text_udf(lambda s: "".join(unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" else c for c in s))
_unquoted = _text_udf(unquote)


def compact(c: Column) -> Column:
    """No white space, no soft hyphen."""
    return F.regexp_replace(c, rf"{WS}|\x{{AD}}", "")


def score_compact(c: Column) -> Column:
    return casefold(compact(c))


def output_key(c: Column) -> Column:
    """URL escapes decoded, no white space, case folded."""
    return casefold(F.regexp_replace(_unquoted(c), WS, ""))


def bridge_key(c: Column) -> Column:
    return casefold(F.regexp_replace(F.coalesce(c, F.lit("")), WS, ""))


def characters(c: Column) -> Column:
    return casefold(F.regexp_replace(c, WS, ""))


def collapse_key(c: Column) -> Column:
    """One space for a run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def visual_normal(c: Column) -> Column:
    """Hyphens that look alike become one, white space goes."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x{2010}-\x{2015}\x{2212}]", "-"), WS, "")


def clean_label(c: Column) -> Column:
    """Collapsed, without one colon at the end."""
    return F.rtrim(F.regexp_replace(collapse_key(c), "[:：]$", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def sensitive_literal(c: Column) -> Column:
    return c.rlike(r"(?U)\d|[@_]|\p{Sc}")


def soft_wraps_as_spaces(c: Column) -> Column:
    """A line break before a lower-case letter is a wrap; the length stays."""
    return F.regexp_replace(c, r"\n(?=\p{Ll})", " ")


def segments(c: Column) -> Column:
    """Parts of a line between '|', tabs or three spaces and more, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\||\t| {3,}"), lambda x: F.trim(x)), lambda x: x != "")


def strip_honorific(c: Column) -> Column:
    """Without a leading title, if letters are left."""
    titled = r"^(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sr|Sra|Srta|Mme|Mlle|M)\.|(?:Mr|Mrs|Ms|Mx|Dr|Prof|Miss|Sir|Madam|Herr|Frau)\b)\s*"
    rest = F.regexp_replace(c, titled, "")
    return F.when(rest.rlike(r"\p{L}"), rest).otherwise(c)


def tidy_dash_key(c: Column) -> Column:
    """Prose without the spacing and dash style that readings differ in."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\x{2010}-\x{2015}\x{2212}-]", ""), WS, "")


# --- scripts ---

#: Script names as Java's regex knows them.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def script(c: Column) -> Column:
    """Of the first character; null for what belongs to none of SCRIPTS."""
    out = F.lit(None).cast("string")
    for name in reversed(SCRIPTS):
        out = F.when(F.substring(c, 1, 1).rlike(rf"\p{{Is{name}}}"), name).otherwise(out)
    return out


def script_counts(c: Column) -> Column:
    """map of script to number of characters, scripts that occur only."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.regexp_count(c, F.lit(rf"\p{{Is{n}}}")).alias("value")) for n in SCRIPTS))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def main_script(c: Column) -> Column:
    """The most frequent script beside Latin, ties in the order of SCRIPTS; null if there is none."""
    pairs = F.transform(F.filter(F.map_entries(script_counts(c)), lambda e: e["key"] != "Latin"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("s")))
    order = F.array_sort(pairs, lambda x, y: F.when(x["n"] > y["n"], -1).when(x["n"] < y["n"], 1).otherwise(0))
    return F.get(order, 0)["s"]


def is_cjk(c: Column) -> Column:
    return c.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def needs_shaping(c: Column) -> Column:
    return c.rlike(r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsThai}]")


def foreign_scripts(source: Column, target: Column, allowed: Column) -> Column:
    """Scripts in target that neither source has nor the language allows, sorted."""
    return F.array_sort(F.array_except(F.array_except(F.map_keys(script_counts(target)), F.map_keys(script_counts(source))), allowed))


def foreign_share(source: Column, target: Column, allowed: Column) -> Column:
    """Share of the target's letters that are in such scripts; 0 without letters."""
    foreign = foreign_scripts(source, target, allowed)
    counts = script_counts(target)
    hit = F.aggregate(foreign, F.lit(0), lambda a, s: a + F.element_at(counts, s))
    all_letters = F.aggregate(F.map_values(counts), F.lit(0), lambda a, n: a + n)
    return F.coalesce(F.try_divide(hit.cast("double"), all_letters), F.lit(0.0))


def display_width(c: Column) -> Column:
    """Characters, wide ones twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"))


# --- layout of one line ---

TOC = r"^(.*?\S)\s*((?:\.\s*){3,}|…+)\s*(\S*)$"


def toc_split(c: Column) -> Column:
    """struct(title, leader, tail) of a contents line; null if there is no leader."""
    parts = F.struct(F.regexp_extract(c, TOC, 1).alias("title"), F.regexp_extract(c, TOC, 2).alias("leader"), F.regexp_extract(c, TOC, 3).alias("tail"))
    return F.when(c.rlike(TOC), parts)


def toc_rebuild(title: Column, translated: Column, leader: Column, tail: Column) -> Column:
    """The leader grows or shrinks with the title's width, to three dots at least."""
    dots = F.greatest(F.lit(3), F.length(leader) + display_width(title) - display_width(translated)).cast("int")
    return F.concat(translated, F.lit(" "), F.repeat(F.lit("."), dots), F.lit(" "), tail)


FIELD = r"^\s*([\p{L}][\p{L} /()_-]{0,59}):\s*(\S[\s\S]*)$"


def split_field(c: Column) -> Column:
    """struct(label, value) of a text that is one 'label: value'; null otherwise."""
    label = F.rtrim(F.regexp_extract(c, FIELD, 1))
    ok = c.rlike(FIELD) & (F.size(F.split(label, r"\s+")) <= 6) & (F.length(label) <= 60)
    return F.when(ok, F.struct(label.alias("label"), F.rtrim(F.regexp_extract(c, FIELD, 2)).alias("value")))


def without_source_echo(source: Column, answer: Column) -> Column:
    """The answer without a copy of the source, of 12 characters or more, at its end."""
    s, a = F.trim(source), F.rtrim(answer)
    echoed = (F.length(s) >= 12) & F.endswith(a, s) & (F.length(a) > F.length(s))
    return F.when(echoed, F.rtrim(F.substring(a, F.lit(1), F.length(a) - F.length(s)))).otherwise(answer)


def match_terminal_punctuation(source: Column, target: Column) -> Column:
    """Drop one full stop that the source does not end with."""
    added = F.rtrim(target).rlike("[.。]$") & ~F.rtrim(target).rlike(r"(\.\.|…)$") & ~F.rtrim(source).rlike("[.。!?！？:：…]$")
    return F.when(added, F.regexp_replace(F.rtrim(target), "[.。]$", "")).otherwise(target)


def middle_dot(target: Column, language: Column) -> Column:
    return F.when(language == "ja", target).otherwise(F.translate(target, "・", "·"))


def cjk_punctuation(target: Column) -> Column:
    """ASCII marks after a CJK character become full width."""
    out = target
    for plain, wide in ((",", "，"), (";", "；"), (":", "："), (r"\?", "？"), ("!", "！")):
        out = F.regexp_replace(out, rf"(?<=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]){plain}(?!\d)", wide)
    return out


def answer_budget(c: Column) -> Column:
    return F.least(F.lit(4096), F.lit(256) + 3 * F.length(c))


def unglued(c: Column) -> Column:
    """A space between a {vN} placeholder and a letter or digit next to it."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[\p{L}\d])(?=\{v\d+\})", " "), r"(?<=\{v\d{1,4}\})(?=[\p{L}\d])", " ")


def glued_placeholders(c: Column) -> Column:
    """Identifiers that stand next to a {vN} placeholder without a space."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\d]+\{v\d+\}[\p{L}\d]*|\{v\d+\}[\p{L}\d]+)"))


def single_line(source: Column, answer: Column) -> Column:
    """Lines of the answer joined by a space if the source is one line."""
    return F.when(F.instr(source, "\n") > 0, answer).otherwise(F.regexp_replace(F.trim(answer), r"\s*\n\s*", " "))


def unit_spacing(source: Column, target: Column) -> Column:
    """'5 mm' as '5mm' in the target if the source writes it so and never the other way."""
    glued, apart = source.rlike(r"\d(?:mm|cm|km|kg|g|ml|l|V|A|W|Hz|GB|MB)\b"), source.rlike(r"\d (?:mm|cm|km|kg|g|ml|l|V|A|W|Hz|GB|MB)\b")
    return F.when(glued & ~apart, F.regexp_replace(target, r"(?<=\d) (?=(?:mm|cm|km|kg|g|ml|l|V|A|W|Hz|GB|MB)\b)", "")).when(apart & ~glued, F.regexp_replace(target, r"(?<=\d)(?=(?:mm|cm|km|kg|g|ml|l|V|A|W|Hz|GB|MB)\b)", " ")).otherwise(target)


def joined_separators(c: Column) -> Column:
    """'2024-03- 20' without the blank that a wrap left."""
    return F.regexp_replace(c, r"(?<=\d[-/.]) +(?=\d)", "")


def split_compounds(source: Column, target: Column) -> Column:
    """'PDF-Datei' as 'PDF Datei' if the head is a word of the source and the compound is not."""
    head = F.regexp_extract(target, r"\b([A-Z]{2,})-\p{Lu}\p{Ll}+", 1)
    ok = (head != "") & F.contains(source, head) & ~F.contains(source, F.concat(head, F.lit("-")))
    return F.when(ok, F.regexp_replace(target, r"\b([A-Z]{2,})-(?=\p{Lu}\p{Ll})", "$1 ")).otherwise(target)


# --- headings and running lines ---


def heading_level(c: Column, size: Column, median: Column, bold: Column) -> Column:
    """Markdown of a block by the ratio of its size to the median."""
    ratio = F.coalesce(F.try_divide(size, median), F.lit(1.0))
    return F.when(ratio >= 1.8, F.concat(F.lit("# "), c)).when(ratio >= 1.4, F.concat(F.lit("## "), c)).when(ratio >= 1.15, F.concat(F.lit("### "), c)).when(bold & (F.length(c) < 80), F.concat(F.lit("**"), c, F.lit("**"))).otherwise(c)


def is_running_line(c: Column, top: Column, height: Column) -> Column:
    """A page number, or a short line in the outer twentieth of the page."""
    return c.rlike(r"^\s*(?:[Pp]age\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$") | ((F.length(c) < 60) & ((top < height * 0.05) | (top > height * 0.95)))


def style_from_name(c: Column) -> Column:
    n = F.lower(F.coalesce(c, F.lit("")))
    return F.struct(n.rlike("bold|black|heavy|semibold").alias("bold"), n.rlike("italic|oblique").alias("italic"), (n.rlike("serif|times|georgia|garamond|roman|mincho|song") & ~n.rlike("sans")).alias("serif"))


# --- distances ---


def edit_counts(reference, hypothesis) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions of a shortest edit; of equal ones, diagonal steps before deletions before insertions."""
    n, m = len(reference), len(hypothesis)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        cost[i][0] = i
    cost[0] = list(range(m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    s = ins = d = 0
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            s += reference[i - 1] != hypothesis[j - 1]
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, ins, d


@arrow("substitutions int, insertions int, deletions int")
def word_edit_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], columns=["substitutions", "insertions", "deletions"])


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein over characters (Spark's own counts characters, not bytes)."""
    return F.levenshtein(a, b)


@arrow("int")
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sum(edit_counts((x or "").split(), (y or "").split())) for x, y in zip(a, b, strict=True)], dtype="int32")


@arrow("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as sequence matchers have it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@arrow("int")
def longest_common_block(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).find_longest_match().size for x, y in zip(a, b, strict=True)], dtype="int32")


def value_match(expected: Column, value: Column) -> Column:
    """'full' if value holds what is expected, 'partial' if expected holds a value of 60 % of its length, else null."""
    e, v = score_compact(expected), score_compact(value)
    return F.when((e == "") | (v == ""), None).when(F.contains(v, e), "full").when(F.contains(e, v) & (F.length(v) >= 0.6 * F.length(e)), "partial")


def text_counts(reference: Column, prediction: Column) -> Column:
    """Errors and lengths in characters and words after normalisation."""
    a, b = normalize(reference), normalize(prediction)
    return F.struct(edit_distance(a, b).alias("character_errors"), F.length(a).alias("reference_characters"), word_distance(a, b).alias("word_errors"), F.when(a == "", 0).otherwise(F.size(F.split(a, " "))).alias("reference_words"))


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (eight places)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)")), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 8, "0")).otherwise(x)), "")

