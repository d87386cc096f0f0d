"""Near-dedup stage of the pipeline against brute force over exact five-word shingle sets."""

import corpus_pipeline
import numpy as np
from pagewright.llm import near


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_finds_near_copies_beyond_two_bits(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n", "one", "two words"]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
        texts.append(" ".join(base))
        for cuts in (1, 2, 3, 4, 6, 9):  # likeness from 0.93 to below 0.6
            w = list(base)
            for at in rng.choice(150, cuts, replace=False):
                w[at] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(w))
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_bands_meet_at_the_likeness():
    rng, met = np.random.default_rng(8), 0
    for _ in range(2000):
        x = np.unique(rng.integers(0, 1 << 63, 180, dtype=np.uint64))
        met += bool(set(near.band_keys(np.sort(x[:162])).tolist()) & set(near.band_keys(np.sort(x[18:])).tolist()))
    assert met >= 1999  # likeness 0.8


def test_simhash_links_near_fingerprints_by_itself(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(8):
        base = [f"w{k}" for k in rng.integers(0, 3000, 4000)]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            w[int(rng.integers(0, 4000))] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(w))
    sets, prints = [grams(t) for t in texts], []
    for t in texts:
        ones = np.zeros(64, int)
        s = near.shingles(t).tolist()
        for x in s:
            ones += [x >> k & 1 for k in range(64)]
        prints.append(sum(1 << k for k in range(64) if 2 * ones[k] > len(s)))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                assert like(sets[a], sets[b]) >= 0.8
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert len(set(root)) < 20  # of 32
    rows_of = near.rows_of  # no bands, so that only fingerprints can link
    monkeypatch.setattr(near, "rows_of", lambda docs: rows_of(docs).withColumn("bands", near.F.array().cast("array<long>")))
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(root))


def test_a_cloud_below_the_likeness_is_no_row_a_pair(spark):
    rng, texts = np.random.default_rng(12), []
    base = [f"w{k}" for k in rng.integers(0, 3000, 120)]
    for _ in range(250):  # likeness to each other about 0.5 to 0.9
        w = list(base)
        for at in rng.choice(120, int(rng.integers(2, 5)), replace=False):
            w[at] = f"x{rng.integers(0, 1 << 30)}"
        texts.append(" ".join(w))
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert 20 < len(set(root)) < 240
    made, verified = [], near.verified

    def counted(pairs, *args):
        made.append(pairs.count())
        return verified(pairs, *args)

    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    near.verified = counted
    try:
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    finally:
        near.verified = verified
    assert got == sorted(set(root))
    assert max(made) <= near.BANDS * len(texts)
