import math
import random
import textwrap
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, documents, prose
from vellumite.llm import byte_bpe, decontaminate, licenses, quality, sharding, token_counts, topk

tokenizers = pytest.importorskip("public_tokenizers")


# --- 2 ---


def labelled(n=300):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, rng.randint(5, 80))
        docs.append((i, text if good else " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_learns_from_training_rows_only(spark):
    docs, labels = labelled()
    d = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "x"), docs[0]], "doc_id long, text string")
    out = quality.scored(d, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)
    # what held-out labels say changes nothing
    flipped = spark.createDataFrame([(i, 1 - q if any(h.doc_id == i for h in held) else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.scored(d, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in held)


def test_quality_of_awkward_rows(spark):
    docs, labels = labelled(120)
    rng = random.Random(1)
    rows = [(i, t, 9.0, False, "x") for i, t in docs] + [(500, prose(rng, 60000), 1.0, True, "x"), (7, "an other text", 0.0, True, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, predicted string")
    marks = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, text string")
    one, two = ({(r.doc_id, round(r.score, 6)) for r in quality.scored(x, marks).collect()} for x in (d, d.repartition(3)))
    assert one == two and len(one) == len(rows) and 500 in {i for i, _ in one}
    with pytest.raises(ValueError):
        quality.scored(d, marks, carry=("score",))


def test_quality_is_not_learnt_in_the_driver(spark):
    docs, labels = labelled(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tracemalloc.start()
    try:
        model = quality.fit(d, marks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.labels) > 300 and peak < 6e6  # the sums of products alone have 17 MB


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.scored(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first().score == 0.5
    assert quality.scored(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- 3 ---


def test_rollup_counts_each_batch_once(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert r.totals().count() == 0
    docs = spark.createDataFrame(documents(), SCHEMA)
    changes = token_counts.counted(docs).withColumn("op", F.lit("insert"))
    assert r.commit("b1", changes) and not r.commit("b1", changes)
    want = {(x.source, x.lang, x.tokenizer): (x.d, x.n) for x in token_counts.counted(docs).groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("d"), F.sum("n_tokens").alias("n")).collect()}
    read = lambda: {(x.source, x.lang, x.tokenizer): (x.documents, x.tokens) for x in r.totals().collect()}
    assert read() == want
    feed = spark.createDataFrame([("revise", "a", None, "t", 7, 3), ("insert", "a", None, "t", 3, None), ("delete", "a", None, "t", 7, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long")
    assert r.commit("b2", feed) and read() == want
    assert r.commit("none", feed.limit(0)) and read() == want and token_counts.deltas(feed.limit(0)).count() == 0
    assert r.commit("b3", changes.withColumn("op", F.lit("delete"))) and read() == {}
    with pytest.raises(Exception, match="unknown op"):
        token_counts.deltas(feed.withColumn("op", F.lit("x"))).collect()
    with pytest.raises(ValueError):
        r.commit("../x", feed)


def test_counts_of_a_real_tokenizer(spark):
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame(documents(), SCHEMA)
    n = byte_bpe.encode_documents(docs, ranks, tokenizers.PATTERN, carry=("source", "lang")).withColumn("tokenizer", F.lit("bpe-50k")).withColumn("op", F.lit("insert"))
    assert token_counts.deltas(n).agg(F.sum("tokens")).first()[0] == n.agg(F.sum("n_tokens")).first()[0]


# --- 4 ---


def test_containment_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 8, 20, 60]))) for i in range(30)] + [(90, None), (91, ""), (None, "x"), (92, "  ")]
    docs = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 50))
        if i % 3 == 0:
            words = (items[rng.randrange(30)][1] or "").split()
            if i % 2:
                words[rng.randrange(len(words))] = "zzz"
            text = f"{text} {' '.join(words).upper()} {text}"
        docs.append((i, text))
    docs += [(70, None), (None, "x"), (71, items[0][1]), (72, prose(rng, 9000) + " " + items[3][1]), docs[0]]
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in docs:
        for k, s in items:
            a = decontaminate.shingles(s)
            b = decontaminate.shingles(t, min(5, len((s or "").split()) or 5))
            if i is not None and k is not None and a and len(a & b) >= 0.8 * len(a):
                want.add((i, k, len(a & b)))
    assert got == want and len(want) > 10


def test_containment_beside_columns_of_like_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 0.5), (1, "a b c d e f", 7, 0.5), (2, "x", 7, 0.5)], "doc_id long, text string, item_id long, containment double")
    items = spark.createDataFrame([(3, "B C D E F", 9, 1)], "item_id long, text string, doc_id long, n_shared int")
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.containment) for r in decontaminate.contained(docs, items).collect()) == [(1, 3, 1, 1.0)] * 2
    assert [r.doc_id for r in decontaminate.without_benchmark(docs, items).collect()] == [2]


def test_containment_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, prose(rng, 12)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    own = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, own).collect()} >= {(i, i) for i in range(20)}
    assert decontaminate.without_benchmark(docs, own).count() == 0 and decontaminate.without_benchmark(docs, own.limit(0)).count() == 20
    assert decontaminate.contained(docs.limit(0), own).count() == 0


# --- 5 ---


@pytest.mark.parametrize("seed, size, block", [(1, 1, 8192), (2, 1, 8192), (3, 1e6, 8192), (4, 1e8, 8192), (5, 1, 9)])
def test_top_k_against_brute_force(spark, seed, size, block, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 70)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, 8)).round(1) * size
    v[50:90] = v[0]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows[7], rows[10], rows[11], rows[12] = (7, None, 1), (10, [1.0, None] * 4, 1), (11, [float("nan")] * 8, 1), (12, [float("inf")] * 8, 1)
    rows += [(500, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (20, rows[21][1], 1)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 5, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = [(i, [math.floor(256 * c) for c in x]) for i, x, _ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dot = lambda x, y: max(-(2**63) + 3, min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True))))
    want = {}
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        x = min(tuple(x) for i, x in ok if i == q)
        best = sorted((-dot(x, y), i) for i, y in ok if i != q and len(y) == len(x))[:5]
        if best:
            want[q] = {k: (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def test_top_k_beside_columns_of_like_names(spark):
    rows = [(i, [float(i)], i, 1, 2) for i in range(4)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id long, rank int, v int"), 2, 50).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_top_k_beyond_a_long(spark):
    rows = [(0, [1e300, -1e300], 1), (1, [1e300, -1e300], 1), (2, [-1e300, 1.0], 1), (3, [1.0, 2.0], 1), (4, [0.5, 0.25], 1)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), 5, 50).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (4, 2**63 - 1), (2, -(2**63) + 3), (3, -(2**63) + 3)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(5)
    for points in (rng.integers(-9, 9, (200, 3)), np.zeros((50, 3), int), rng.integers(0, 2, (1, 4))):
        tree = topk.CoverTree(points)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(points)))
        centre, radius = tree.levels[-1]
        for leaf, c, r in zip(tree.leaves, centre, radius, strict=True):
            assert (np.linalg.norm(points[leaf] - points[c], axis=1) <= r + 1e-9).all()


# --- 6 ---


def test_licenses(spark):
    isc = next(t for i, t in licenses.KNOWN if i == "ISC")
    wrapped = lambda i, width: textwrap.fill(next(t for k, t in licenses.KNOWN if k == i), width)
    files = {
        11: ("MIT", "MIT License\n\nCopyright (c) 2020 Ann Moor\n\n" + wrapped("MIT", 78)),
        12: ("ISC", "ISC License\r\n\r\nCopyright 2020, Ann\r\nCopyright (c) 2021 by Bob\r\nAll rights reserved.\r\n\r\n" + wrapped("ISC", 60).replace("\n", "\r\n")),
        13: ("BSD-1-Clause", "// Copyright © Ann\n" + wrapped("BSD-1-Clause", 40)),
        14: ("BSD-3-Clause", "BSD 3-Clause License\n" + wrapped("BSD-3-Clause", 79).replace("Redistributions", "* Redistributions")),
        15: ("Unlicense", wrapped("Unlicense", 70)),
    }
    files |= {100 + w: ("ISC", wrapped("ISC", w)) for w in range(40, 100)}  # wherever "copyright notice" comes to stand
    long = spark.createDataFrame([(k, t, "x") for k, (_, t) in files.items()] + [(99, isc + " word" * 300000, "x"), (11, files[11][1], "x")], "doc_id long, text string, digest string")
    out = licenses.scan(long, licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license_id for r in out} == {k: i for k, (i, _) in files.items()} | {99: None} and len(out) == len(files) + 2
    assert licenses.scan(long.limit(0), licenses.known_licenses(spark)).count() == 0
    rows = [(1, isc), (2, "Copyright (c) 2024 Ann\n" + isc.upper().replace(",", " ;")), (3, isc + " more"), (4, None), (5, ""), (6, "licensed under the MIT licence"), (7, "(c) 2020 X\nLicensed under  CC BY-NC 4.0"), (None, isc)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license_id for r in out} == {1: "ISC", 2: "ISC", 3: None, 4: None, 5: None, 6: "MIT-notice", 7: "CC-BY-NC-4.0-notice", None: "ISC"}
    tied = licenses.known_licenses(spark, [("b", "Same text"), ("a", "same  TEXT.")]).collect()
    assert [r.license_id for r in tied] == ["a"]


# --- 7 ---


def test_bpe_against_the_library(spark):
    import hashlib

    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "b", "e", " ", "th", "ing", "é", "日", "\n", "1", "!!", "ß", "  ", "x" * rng.randint(1, 40), chr(rng.randint(0, 0x2FFF))]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts = [None, "", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>", *odd, prose(rng, 5000), " lead", "trail ", "a  b", "don't we'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for fast in (True, False):
        for r in byte_bpe.encode_documents(df, ranks, tokenizers.PATTERN, space_leads=fast, keep_ids=True).collect():
            text = texts[r.doc_id] or ""
            want = library.encode_ordinary(text)
            assert r.token_ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.round_trip
    assert byte_bpe.encode_documents(df.limit(0), ranks, tokenizers.PATTERN).count() == 0


def test_bpe_of_repeated_rows_and_like_names(spark):
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    df = spark.createDataFrame([(1, "some text", 5, "x"), (1, "some text", 5, "x"), (None, None, 1, "y")], "doc_id long, text string, n_tokens long, ids_sha256 string")
    assert sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in byte_bpe.encode_documents(df, ranks, tokenizers.PATTERN).collect()) == [(0, 0, True), (1, 2, True), (1, 2, True)]
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(df, ranks, tokenizers.PATTERN, carry=("n_tokens",))


def test_bpe_in_pieces_and_with_small_memories(monkeypatch):
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    text = prose(random.Random(3), 3000)
    want = byte_bpe.Codec(ranks, tokenizers.PATTERN).encode(text)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 100)
    for memory in ("MEMO", "MEMO_OF_RUNS", "PAIRS"):
        monkeypatch.setattr(byte_bpe, memory, 10)
    small = byte_bpe.Codec(ranks, tokenizers.PATTERN, True)
    assert small.encode(text) == want and small.decode(want) == text.encode()
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0}, tokenizers.PATTERN).encode("b")


def test_bpe_encodes_new_short_pieces_together(monkeypatch):
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", "'s", "é", "7"]) for _ in range(4000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 4000, 50)] + ["", "a  b\n c", " ", "x" * 100, "end "]
    alone = []
    monkeypatch.setattr(byte_bpe.Codec, "encode_piece", lambda self, piece, f=byte_bpe.Codec.encode_piece: alone.append(piece) or f(self, piece))
    codec = byte_bpe.Codec(ranks, tokenizers.PATTERN, True)
    for _ in range(2):
        assert [[i for part in parts for i in part.tolist()] for parts in codec.ids(texts)] == [library.encode_ordinary(t) for t in texts]
    assert set(alone) == {b"x" * 100}
    # any ranks will do: merges are made by rank, the first of equal ones first, and a whole token needs none
    few = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"aa": 259, b"aaa": 260, b"cab": 261, b"xyz": 262}
    library, codec = tiktoken.Encoding("few", pat_str=tokenizers.PATTERN, mergeable_ranks=few, special_tokens={}), byte_bpe.Codec(few, tokenizers.PATTERN, True)
    for text in ("".join(rng.choice("aaabbcxyz ") for _ in range(200)) for _ in range(50)):
        assert codec.encode(text) == library.encode_ordinary(text)


# --- 8 ---


@pytest.mark.parametrize("n, shards", [(600, 7), (40, 40), (3, 5), (0, 4)])
def test_shards(spark, n, shards):
    import zlib

    rng = random.Random(n)
    rows = [(i if i % 50 else None, prose(rng, rng.randint(0, 60)) if i % 4 else rng.choice(["hot copy " * 20, None]), rng.choice(["en", "de", None]), rng.choice(["hot", "s2", None]), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    out = sharding.shards(df, shards).collect()
    assert len(out) == n
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by = {}
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if n == 600:
        sizes = [sum(r.size for r in by[s]) for s in range(shards)]
        assert max(sizes) < 1.06 * sum(sizes) / shards and min(sizes) > 0.94 * sum(sizes) / shards
    if n:
        whole_copies(out, shards)


def whole_copies(out, shards):
    """Equal texts lie in one shard, or in no more than their bytes fill."""
    target, groups = sum(r.size for r in out) / shards, {}
    for r in out:
        groups.setdefault((r.text_crc32, r.size), []).append(r.shard)
    for (_, size), at in groups.items():
        assert len(set(at)) <= max(1, math.ceil(len(at) * size / target))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_shards_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    out = sharding.shards(docs, 40).collect()
    whole_copies(out, 40)
    sizes, largest = [sum(r.size for r in out if r.shard == s) for s in range(40)], max(r.size for r in out)
    assert max(sizes) - min(sizes) <= max(largest, 0.05 * sum(sizes) / 40), (min(sizes), max(sizes), largest)


def test_shards_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30), "en", "s", 1) for i in range(200)] + [(500, prose(rng, 20000), "en", "s", 1)] + [(501, "again " * 50, "de", None, 2)] * 30
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int"), 5).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    assert len({(r.shard, r.slot) for r in out}) == len(rows)
    alone = [r.shard for r in out if r.doc_id == 500]
    assert sum(r.size for r in out if r.shard not in alone) < 0.5 * sum(r.size for r in out)


def test_large_groups_go_to_the_emptiest_shard():
    heavy = [(1, 0, 10, 100, 1000), (2, 0, 50, 3, 150), (3, 0, 10, 14, 140), (4, 0, 900, 1, 900)]
    laid, room = sharding.lay(heavy, 300.0, 6)
    assert sorted((g, pieces, k) for g, _, _, pieces, k, _ in laid) == [(1, 4, 0), (1, 4, 1), (1, 4, 2), (1, 4, 3), (2, 1, 0), (3, 1, 0), (4, 1, 0)]
    at = {(g, k): s for g, _, _, _, k, s in laid}
    assert len({s for (g, _), s in at.items() if g != 3}) == 6 and at[3, 0] == at[2, 0] and sorted(room) == [0, 10, 50, 50, 50, 50]

# --- the pipeline ---


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tests.llm.test_near import brute_roots

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id", "text").collect()}
    ids = sorted(kept)
    root = brute_roots([kept[i] for i in ids])
    heads = {ids[k]: kept[ids[k]] for k in set(root)}
    first = {}
    for i in sorted(heads):
        w = heads[i].encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    left = {}
    for i, t in heads.items():
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else t
        if text or not any(gone):
            left[i] = text
    items = [decontaminate.shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: t for i, t in left.items() if not any(s and len(s & decontaminate.shingles(t)) >= 0.8 * len(s) for s in items)}
    codec = byte_bpe.Codec(byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    assert set(out) == set(clean)
    assert all(list(out[i].token_ids) == codec.encode(t) for i, t in clean.items())
