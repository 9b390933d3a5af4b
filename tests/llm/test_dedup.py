import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.data import SCHEMA, documents
from vellumite.llm import _shared, components, simhash, substring, suffix_dedup
from vellumite.llm._shared import Rolling, anchors


def brute_bytes(rows, least):
    docs = {(i, (t or "").encode()) for i, t, *_ in rows if i is not None}
    count = Counter(x[k : k + least] for _, x in docs for k in range(len(x) - least + 1))
    out = {}
    for i, x in docs:
        gone = [False] * len(x)
        for k in range(len(x) - least + 1):
            if count[x[k : k + least]] > 1:
                gone[k : k + least] = [True] * least
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2, 0])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2 and 0: buckets go the way of hot ones
    rows = documents()
    df = spark.createDataFrame([*rows, (None, rows[0][1], "en", "s", 1, 0.0, "z")], SCHEMA)
    out = suffix_dedup.removed(df, 100, 16, keep_text=True).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    want = brute_bytes(rows, 100)
    assert got == {i: w[:4] for i, w in want.items()} and len(out) == len(got)
    assert all(bytes(r.kept) == want[r.doc_id][4] for r in out if r.n_removed)


def brute_words(rows, window):
    docs = {(i, tuple((t or "").encode().split())) for i, t, *_ in rows}
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            first[w[k : k + window]] = min(i, first.get(w[k : k + window], i))
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[w[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([*rows, (None, rows[0][1], "en", "s", 1, 0.0, "z")], SCHEMA)
    out = substring.removed(df, 20, 8).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, 20) and len(out) == len({r[0] for r in rows})


def test_sketch_loses_no_repeat(spark):
    rows = spark.createDataFrame([(i, "d", h) for i, h in enumerate([1, 2, 2, 3, 4, 4, 4, 5])], "doc_id long, digest string, h long")
    assert {2, 4} <= {r.h for r in substring.repeated(rows, 8).collect()}


@pytest.mark.parametrize("share", [0, 0.02, 1])
def test_hot_keys_are_kept_like_others(spark, monkeypatch, share):
    monkeypatch.setattr(_shared, "HOT_SHARE", share)  # 0: every shared key is hot; 1: none
    rows = [(i, str(i % 7), k) for i, k in enumerate([1, 2, 2, 3, *[4] * 200, 5, 5, None, None])]
    out = _shared.of_several(spark.createDataFrame(rows, "doc_id long, digest string, h long"), "h")
    assert out.columns == ["h", "doc_id", "digest"] and Counter(r.h for r in out.collect()) == {2: 2, 4: 200, 5: 2}


@pytest.mark.parametrize("run", [suffix_dedup.removed, substring.removed, simhash.near_duplicates])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_transform_against_brute_force():
    rng = np.random.default_rng(0)
    for least in (3, 9):
        for _ in range(40):
            parts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
            count = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
            want = [[i for i in range(len(p) - least + 1) if count[p[i : i + least]] > 1] for p in parts]
            assert [g.tolist() for g in suffix_dedup.repeated_starts(parts, least)] == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 3000).astype(np.uint8)
    text[2000:2300] = text[500:800]
    r = Rolling(5)
    keys = r.all_of(r.prefix(text), 8)
    place, lo, hi = anchors(keys, 43, np.array([0]), np.array([len(keys)]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert starts.tolist() == list(range(3000 - 50 + 1))
    at = dict(zip(starts.tolist(), np.repeat(place - 0, hi - lo + 1).tolist(), strict=True))
    assert all(at[2000 + k] - (2000 + k) == at[500 + k] - (500 + k) for k in range(251))


@pytest.mark.parametrize("bits", [7, 10, _shared.PLACE_BITS])
def test_anchors_do_not_depend_on_the_run(monkeypatch, bits):
    monkeypatch.setattr(_shared, "PLACE_BITS", bits)  # 7 and 10: runs of several passes
    rng = np.random.default_rng(4)
    window = rng.integers(0, 2**64, 43, dtype=np.uint64)
    window[20] = window[5] = 0  # a tie: the leftmost
    for n in (100, 1000, 200_000, (1 << 22) + 500):
        if bits < 20 and n > 1000:
            break
        run = rng.integers(0, 2**64, n, dtype=np.uint64)
        at = [0, n // 2, n - 43, min(n - 43, (1 << bits) - 60)] if n > 300 else [30]
        for a in at:
            run[a : a + 43] = window
            assert _shared.least_places(run, 43)[a] - a == 5
    keys = rng.integers(0, 50, 900, dtype=np.uint64) << np.uint64(40)
    assert _shared.least_places(keys, 43).tolist() == [i + int(np.argmin(keys[i : i + 43])) for i in range(900 - 42)]


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_results_do_not_depend_on_batches(spark, batch):
    rows = documents(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df, 100, 16).collect()}
        words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removed(df, 20, 8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: w[:4] for i, w in brute_bytes(rows, 100).items()} and words == brute_words(rows, 20)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)  # keys are cut further, as hot ones are
    rows = documents(5, 80)
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    ids, root = sorted(fp), {}
    for i in ids:
        root[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def test_gray_index_against_brute_force():
    rng = np.random.default_rng(1)
    v = [int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for x in v[:60]:
        for _ in range(6):
            y = x
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            v.append(y)
    v = np.unique(np.array(v, np.uint64))
    index = simhash.GrayIndex(v)
    got = {frozenset((int(index.values[x]), int(index.values[y]))) for a, b in index.pairs(2) for x, y in zip(a, b, strict=True)}
    want = {frozenset((int(v[i]), int(v[j]))) for i in range(len(v)) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= 2}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_substring_dedup_moves_texts_without_repeats_once(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.integers(0, 2**40, 1500).astype(str)) for _ in range(120)]
    texts[100:110] = [f"{t} {' '.join(texts[0].split()[:60])}" for t in texts[100:110]]
    size = sum(map(len, texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        found = {r.doc_id: r.n_removed for r in substring.removed(df).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {i for i, n in found.items() if n} == set(range(100, 110)) and set(found.values()) == {0, 60}
    assert moved < 1.5 * size


def test_substring_dedup_takes_a_repeated_line_as_one_stretch(spark, monkeypatch):
    rng = np.random.default_rng(8)
    line, other = (" ".join(rng.integers(0, 2**40, 12).astype(str)) for _ in range(2))
    rows = [(1, " ".join([line] * 60)), (2, " ".join([other] * 9 + [line] * 90)), (3, " ".join([line] * 7 + ["x"] + [line] * 30)), (4, "a " * 300), (5, "b " + "a " * 200)]
    count, keep = {}, substring.written

    def written(df, name):
        out = keep(df, name)
        count[name] = out.count()
        return out

    monkeypatch.setattr(substring, "written", written)
    out = substring.removed(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, 20)
    assert count["stretches"] < 40, count
