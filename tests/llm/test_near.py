import random

from tests.llm.data import SCHEMA, documents, prose
from vellumite.llm import near, simhash
from vellumite.llm.decontaminate import shingles


def near_rows(seed):
    """Documents with copies of which some words are changed, at similarities on both sides of 0.8."""
    rng = random.Random(seed)
    rows = documents(seed, 60)
    for i in range(60):
        words = (rows[rng.randrange(60)][1] or "").split() or ["x"]
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = "other"
        rows.append((1000 + i, " ".join(words), "en", "s", 1, 0.5, "x"))
    base = prose(rng, 120)
    for i in range(30):
        rows.append((2000 + i, f"{base} {prose(rng, rng.randint(1, 40))}", "en", "s", 1, 0.5, "x"))
    return rows


def brute_roots(texts, share=0.8):
    """Of each place of texts, the least place that it reaches."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= share * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def test_near_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "SAMPLE", 1)  # so that there are common shingles
    rows = near_rows(3)
    out = near.grouped(spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "id long, text string")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.component, []).append(r.id)
    least = {i: min(g) for g in groups.values() for i in g}
    want = brute_roots([r[1] for r in rows])
    assert len(out) == len(rows) and [least[k] for k in range(len(rows))] == want
    assert len(set(want)) < len({frozenset(shingles(r[1])) for r in rows})


def test_near_stage_takes_pairs_beyond_two_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    root = brute_roots([t for _, t in texts])
    want = {texts[k][0] for k in set(root)}
    far = [(i, texts[root[k]][0]) for k, (i, t) in enumerate(texts) if (simhash.fingerprint(t) ^ simhash.fingerprint(texts[root[k]][1])).bit_count() > 2]
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want) and far


def test_near_copies_of_one_text_are_not_compared_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "SAMPLE", 1)
    rng = random.Random(11)
    base, texts = prose(rng, 150).split(), []
    for i in range(240):
        words = list(base)
        for _ in range(1 + i % 6):
            words[rng.randrange(150)] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    compared, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, sets, share: compared.append(pairs.count()) or verified(pairs, sets, share))
    groups = {}
    for r in near.grouped(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect():
        groups.setdefault(r.component, []).append(r.id)
    least = {i: min(g) for g in groups.values() for i in g}
    assert [least[k] for k in range(240)] == brute_roots(texts)
    assert sum(compared) < 8 * 240, compared


def test_near_of_nothing(spark):
    import corpus_pipeline

    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
