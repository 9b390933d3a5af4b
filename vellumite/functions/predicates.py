"""Row rules as boolean or error-code expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumite.functions import geometry, text

# Categories of personal data, job options and reasons.
CATEGORIES = ["Email addresses", "Phone numbers", "Names", "Addresses", "Identifiers", "Bank accounts", "Dates of birth"]
OPT_IN_CATEGORIES = ["Dates of birth"]
METHODS = ["field_label", "pattern", "credential_label_pattern", "address_block", "model_proposal", "document_name_sweep", "name_variant", "document_consistency", "unverifiable_model_answer"]
REASONS = ["unverified_answer", "whole_line", "rule_overruled_model", "unreadable_text", "final_check"]
JOB_STATES = ["uploading", "queued", "running", "succeeded", "failed", "cancelled", "interrupted"]

NUMERIC_DATE = r"(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"


def is_date(c: Column) -> Column:
    """A value that is one numeric date, full stops at its end aside."""
    return F.regexp_replace(F.trim(c), r"\.+$", "").rlike(f"^{NUMERIC_DATE}$")


def plausible(value: Column, category: Column) -> Column:
    """Identifiers and accounts hold a digit or a mark of one, names no digit; a plain date is a date of birth."""
    v = F.regexp_replace(F.trim(value), "[.,;:]+$", "")
    lacks_mark = category.isin("Identifiers", "Bank accounts") & ~v.rlike(r"[\d_@.:/#-]")
    digit_name = (category == "Names") & v.rlike(r"(?U)\d")
    return (v != "") & ~lacks_mark & ~digit_name & ~((category != "Dates of birth") & is_date(v))


def phone_shape(c: Column) -> Column:
    """At most one line break, with a separator inside a line or a leading '+'; not a row of years."""
    breaks = F.regexp_count(c, F.lit(r"\n"))
    lines = F.transform(F.split(c, r"\n"), lambda x: F.trim(x))
    anchored = c.startswith("+") | F.exists(lines, lambda x: x.rlike(r"\d[- ().\t]+\d"))
    groups = F.regexp_extract_all(c, F.lit(r"(\d+)"))
    years = (F.size(groups) > 0) & F.forall(groups, lambda g: (F.length(g) == 4) & g.between("1900", "2099"))
    return (breaks <= 1) & ((breaks == 0) | anchored) & ~years


def label_like(c: Column) -> Column:
    """A short phrase with letters and no digits that is not a sentence or a piece of one."""
    t = F.trim(F.regexp_replace(F.trim(c), "[:：]+$", ""))
    words = F.filter(F.split(t, f"{text.WS}+"), lambda w: w != "")
    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    sentence = t.rlike(r"[!?]$") | (t.endswith(".") & (F.length(last) > 4))
    balanced = (F.regexp_count(t, F.lit(r"\(")) == F.regexp_count(t, F.lit(r"\)"))) & (F.regexp_count(t, F.lit(r"\[")) == F.regexp_count(t, F.lit(r"\]")))
    return balanced & (F.length(t) > 0) & (F.length(t) <= 48) & (F.size(words) <= 6) & t.rlike(r"\p{L}") & ~t.rlike(r"(?U)\d") & ~sentence & ~t.rlike("@|://|/")


def reads_as_label(s: str) -> bool:
    """label_like() of one Python string, for operators that work on offsets."""
    s = s.strip().rstrip(":：").strip()
    words = s.split()
    if not 0 < len(s) <= 48 or len(words) > 6 or s[-1] in "!?" or (s[-1] == "." and len(words[-1]) > 4):
        return False
    balanced = s.count("(") == s.count(")") and s.count("[") == s.count("]")
    return balanced and any(c.isalpha() for c in s) and not any(c.isdigit() for c in s) and not any(x in s for x in ("@", "://", "/"))


def format_ok(value: Column, category: Column) -> Column:
    """A labelled value has the format of its category, where that has one."""
    n = F.regexp_count(value, F.lit(r"(?U)\d"))
    email, phone = text.compact(value).rlike(f"(?U)^{EMAIL}$"), F.trim(value).rlike(r"(?U)^[\d\s()+./-]+$") & n.between(8, 15)
    return F.when(category == "Email addresses", email).when(category == "Phone numbers", phone).otherwise(True)


def normalize_category(value: Column, category: Column) -> Column:
    """A format that leaves no doubt overrides the category."""
    flat, t = text.compact(value), F.trim(value)
    ip = flat.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & F.forall(F.split(flat, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    phone = t.rlike(r"^\+?\d[\d ()\t.-]{6,}\d$") & phone_shape(value) & F.length(text.digits(value)).between(8, 15) & category.isin("Identifiers", "Phone numbers") & ~value.rlike("[A-Za-z]")
    return F.when(flat.rlike(f"(?U)^{EMAIL}$"), "Email addresses").when(ip, "Identifiers").when(phone, "Phone numbers").otherwise(category)


def address_part(c: Column) -> Column:
    t = F.trim(c)
    n = F.regexp_count(t, F.lit(r"(?U)\d"))
    return F.length(t).between(2, 40) & (F.size(F.split(t, f"{text.WS}+")) <= 6) & n.between(1, 7) & ~t.rlike("[:：@]") & ~is_date(t)


def kept_visible(value: Column, keep: list[str]) -> Column:
    """Whether the value is part of an entry of keep; an entry never frees a longer value."""
    v = text.score_compact(value)
    entries = ["".join(k.split()).casefold() for k in keep if k.split()]
    return (v != "") & reduce(lambda a, b: a | b, (F.contains(F.lit(k), v) for k in entries), F.lit(False))


def is_glossary_label(c: Column) -> Column:
    words = F.filter(F.split(c, f"{text.WS}+"), lambda w: w != "")
    letters, n = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"(?U)\d"))
    wide = text.display_width(c) - F.length(c)
    return F.size(words).between(1, 4) & (F.length(c) <= 40) & ~F.rtrim(c).rlike("[.。．!?！？]$") & (wide <= 16) & (letters >= 2) & (n <= letters) & ~c.rlike(r"@|\d{3,}|[A-Za-z]+-\d|https?:")


def name_like(c: Column) -> Column:
    """A brand, name or code by its casing: a capital inside a word, all capitals, or every word with a capital."""
    words = F.split(F.trim(c), f"{text.WS}+")
    return c.rlike(r"\p{Ll}\p{Lu}|^\p{Lu}{2,}[\p{Lu}\d-]*$|\p{L}\d") | ((F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")))


def kept_unchanged(source: Column, target: Column) -> Column:
    """Whether a glossary keeps an entry as it is written: a name, code or brand, to be locked like a protected value."""
    return (source == target) & source.rlike(r"\p{L}") & name_like(source)


def is_product_name(c: Column) -> Column:
    """A value of a product column: up to four words on one line with a model token or a brand and a number, no price or link."""
    v = F.trim(c)
    model, brand = r"\b[A-Za-z]+[A-Za-z-]*\d[A-Za-z0-9-]*\b", r"\b[A-Z][a-z]+[A-Z][A-Za-z]*\s+\d+\b"
    return F.length(v).between(2, 100) & (F.size(F.split(v, r"\s+")) <= 4) & ~v.contains("\n") & (v.rlike(model) | v.rlike(brand)) & ~v.rlike("[@:$€£¥₩]")


def is_source_atom(c: Column) -> Column:
    """Only numbers, acronyms and codes, and marks between them."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\d]+(?:-[\p{L}\d]+)*)"))
    atom = lambda w: w.rlike(r"^\d+$|^[A-Z]{2,8}\d*$") | (w.rlike("-") & w.rlike(r"\d") & w.rlike(r"\p{L}"))
    return (F.size(words) > 0) & F.forall(words, atom)


def significant(c: Column) -> Column:
    """A literal that is worth checking."""
    n = F.regexp_count(c, F.lit(r"\d"))
    return F.contains(c, F.lit("@")) | (c.rlike(r"\p{L}") & (n >= 2) & (F.length(c) >= 5)) | (n >= 4)


CURRENCY_AMOUNT = r"^(?:[A-Z]{3}\s*|[$€£¥₩]\s*)\d+(?:,\d+)*(?:\.\d+)?$"


def needs_no_translation(c: Column, protected: Column) -> Column:
    t = F.trim(c)
    return (t == "") | F.array_contains(protected, t) | t.rlike(CURRENCY_AMOUNT) | t.rlike(r"^[A-Z]{2,}(?:-[A-Za-z0-9]+)+$") | t.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$") | t.rlike(r"^[\d\s.,:%/+-]+$")


def needs_scope_context(c: Column) -> Column:
    """A short text that ends in 'only', or that joins prose with a coded identifier."""
    n = F.size(F.split(F.trim(c), f"{text.WS}+"))
    coded = c.rlike(r"\b(?=[A-Za-z0-9-]*\d)[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\b")
    prose = F.regexp_replace(c, r"\b(?=[A-Za-z0-9-]*\d)[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\b", "").rlike(r"\p{L}{2,}")
    return (n <= 8) & (F.lower(F.trim(c)).rlike(r"\bonly[.]?$") | (coded & prose))


def valid_terminology(m: Column) -> Column:
    """At most 100 entries, of 200 characters at most, none empty."""
    ok = lambda s: (F.trim(s) != "") & (F.length(s) <= 200)
    return (F.size(m) <= 100) & F.forall(F.map_entries(m), lambda e: ok(e["key"]) & ok(e["value"]))


def rectangular(cells: Column) -> Column:
    """At least one row, none empty, all as long."""
    return (F.size(cells) > 0) & (F.size(F.array_distinct(F.transform(cells, F.size))) == 1) & (F.size(cells[0]) > 0)


def page_kind(has_text: Column, has_image: Column) -> Column:
    return F.when(has_text & has_image, "mixed").when(has_text, "digital").when(has_image, "image_only").otherwise("vector_or_empty")


def visible(owner: Column, baseline: Column, user: Column, role: Column) -> Column:
    """A job's owner sees it, an administrator all, reviewers the baselines."""
    return (owner == user) | (role == "admin") | (baseline & role.isin("reviewer", "tester"))


# Failure codes by kind of error.
FAILURES = {"TimeoutError": "TIMEOUT", "MemoryError": "OUT_OF_MEMORY", "ConnectionError": "ENGINE_UNAVAILABLE", "ValueError": "INPUT_REJECTED", "PermissionError": "INPUT_REJECTED"}


def failure_code(kind: Column) -> Column:
    out = F.lit("PROCESSING_FAILED")
    for k, v in FAILURES.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.when(kind.isNull(), None).otherwise(out)


def upload_error(filename: Column, size: Column, head: Column, pages: Column, limit: int = 50 << 20, most_pages: int = 200) -> Column:
    """Null for a file that may come in, else the first rule that it breaks."""
    return (
        F.when(filename.isNull() | (F.length(filename) > 180) | filename.rlike(r"[/\\\r\n\x{0}]") | ~F.lower(filename).endswith(".pdf"), "FILENAME")
        .when(size > limit, "TOO_LARGE")
        .when(~F.contains(F.substring(head, 1, 1024), F.lit(b"%PDF-")), "NOT_PDF")
        .when(~pages.between(1, most_pages), "PAGES")
    )


OPTIONS = {"mode": ["pii", "translation", "combined"], "style": ["box", "label", "pseudonym"], "speed": ["fast", "balanced", "thorough"]}


def option_error(raw: Column) -> Column:
    """Null for job options (JSON) that are allowed, else a code: unknown key, bad value, bad language."""
    keys = F.json_object_keys(raw)
    known = F.array(*(F.lit(k) for k in (*OPTIONS, "language", "pages")))
    out = F.when(keys.isNull(), "NOT_AN_OBJECT").when(F.size(F.array_except(keys, known)) > 0, "UNKNOWN_OPTION")
    for k, allowed in OPTIONS.items():
        v = F.get_json_object(raw, f"$.{k}")
        out = out.when(v.isNotNull() & ~v.isin(allowed), f"BAD_{k.upper()}")
    language = F.get_json_object(raw, "$.language")
    return out.when(language.isNotNull() & ~language.rlike("^[a-z]{2,3}(?:-[A-Za-z]{2,4})?$"), "BAD_LANGUAGE").when(F.length(raw) > 65536, "TOO_LARGE")


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def counter_warnings(counters: Column) -> Column:
    """'name: n' of every counter above zero, in the map's order."""
    return F.transform(F.filter(F.map_entries(counters), lambda e: e["value"] > 0), lambda e: F.format_string("%s: %d", e["key"], e["value"]))


def bounded_count(c: Column, most: int = 1_000_000) -> Column:
    return F.when(c.between(0, most), c).otherwise(0)


def unit_box(item: Column, slack: float) -> Column:
    ok = (item["x"] >= -slack) & (item["y"] >= -slack) & (item["width"] > 0) & (item["height"] > 0)
    return ok & (item["x"] + item["width"] <= 1 + slack) & (item["y"] + item["height"] <= 1 + slack)


def review_items(items: Column, pages: Column, limit: int = 200) -> Column:
    """The first `limit` items that are allowed: the filter comes before the limit."""
    ok = lambda i: i["page"].between(1, pages) & unit_box(i, 1e-4) & i["state"].isin("masked", "suggested") & i["reason"].isin(REASONS)
    return F.slice(F.filter(items, ok), 1, limit)


def review_items_of_first(items: Column, pages: Column, limit: int = 200) -> Column:
    """The items among the first `limit` that are allowed: the limit comes before the filter."""
    ok = lambda i: i["page"].between(1, pages) & unit_box(i, 1e-4) & i["state"].isin("masked", "suggested") & i["reason"].isin(REASONS)
    return F.filter(F.slice(items, 1, limit), ok)


def area_rule(item: Column) -> Column:
    """A manual area lies on the page, but for rounding."""
    return unit_box(item, 1e-7)


def duplicate_sources(entries: Column) -> Column:
    """Whether two glossary entries have one source, case and outer blanks aside."""
    keys = F.transform(entries, lambda e: F.lower(F.trim(e["source"])))
    return F.size(keys) > F.size(F.array_distinct(keys))


def document_rules(sha: Column, coordinates: Column, pages: Column) -> Column:
    """Broken rules of a document: hash, coordinate system, page numbers, regions."""
    numbers = F.transform(pages, lambda p: p["number"])
    ids = F.flatten(F.transform(pages, lambda p: F.transform(p["regions"], lambda r: r["id"])))
    kinds = F.flatten(F.transform(pages, lambda p: F.transform(p["regions"], lambda r: r["kind"])))
    boxes_ok = F.forall(pages, lambda p: F.forall(p["regions"], lambda r: (F.size(r["bbox"]) == 4) & geometry.valid(geometry.from_array(r["bbox"]), p["width"], p["height"])))
    return problems({
        "source_sha256": ~F.coalesce(sha.rlike("^[0-9a-f]{64}$"), F.lit(False)), "coordinate_system": ~F.coalesce(coordinates == "top-left displayed-page points", F.lit(False)),
        "page_numbers": F.exists(numbers, lambda n: n < 1) | (F.size(F.array_distinct(numbers)) < F.size(numbers)),
        "region_ids": F.size(F.array_distinct(ids)) < F.size(ids), "kinds": F.exists(kinds, lambda k: ~k.isin("text", "table", "figure", "raster_page")), "boxes": ~boxes_ok,
    })
