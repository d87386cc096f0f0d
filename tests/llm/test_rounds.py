"""Training of op7 covers every training document, and is worth it."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pagewright.llm import attention, lm
from pagewright.llm.common import Scratch

PATH = P.path("byte_bpe_50k.json")


def test_every_block_is_learnt_from_once(monkeypatch):
    rng, seen = np.random.default_rng(0), []
    m = attention.init(50, 8, rng.integers(1, 100, 50))
    real = attention.gradients
    monkeypatch.setattr(attention, "gradients", lambda m, given, goal, first: (seen.append(goal[goal >= 0]), real(m, given, goal, first))[1])
    texts = [rng.integers(0, 49, n) for n in rng.integers(0, 90, 300)]
    own = attention.Trainer(m, 49, 10_000, 3e-3)
    own.feed(texts)
    want = np.concatenate([*texts, np.full(len(texts), 49)])
    assert np.array_equal(np.bincount(np.concatenate(seen), minlength=50), np.bincount(want, minlength=50)) and len(seen) > 1
    assert own.seen == len(want)


def test_rounds_take_every_training_document_once(spark):
    texts = [f"text number {k} of the rounds" for k in range(400)] + [None, ""]
    table = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    start = attention.init(lm.VOCABULARY, lm.DIM, np.ones(lm.VOCABULARY))
    rounds = [lm.in_round(table, k) for k in range(len(lm.ROUNDS))]
    own = [(r.doc_id, r.text) for r in table.collect() if not lm.is_held_out(r.doc_id)]
    assert Counter((r.doc_id, r.text) for d in rounds for r in d.collect()) == Counter(own)
    got = sum(r.weight for d in rounds for r in lm.trained(d.select("text").repartition(3), start, PATH, 1000).collect())
    assert got == sum(len(x) + 1 for x in lm.encode([lm.words_of(t or "") for _, t in own], PATH))


def test_model_beats_the_base_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_IDS", 300_000)
    rng = np.random.default_rng(6)
    stems, ends = ["walk", "talk", "paint", "jump", "count"], ["ed the", "ing a", "s no"]
    texts = [" ".join(f"{rng.choice(stems)}{rng.choice(ends)} {rng.choice(['red', 'blue'])} {rng.integers(0, 500)} times" for _ in range(20)) for _ in range(250)]
    got = lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    out = [r for r in got if r.held_out]
    assert len(out) == sum(zlib.crc32(str(k).encode()) % 7 == 2 for k in range(250)) > 10
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_averages_weigh_embeddings_by_what_was_met(spark):
    import pickle

    rows = [(3, pickle.dumps((np.full(4, v, np.float32), np.full((2, 3), v, np.float32), np.array([n, 0])))) for v, n in ((1.0, 1), (2.0, 3))]
    parts = spark.createDataFrame(rows, "weight long, body binary").coalesce(1)
    (r,) = lm._average(parts).collect()
    flat, emb, met = pickle.loads(r.body)
    assert r.weight == 6 and np.allclose(flat, 1.5) and np.allclose(emb[0], 1.75) and met.tolist() == [4, 0]


def plain(m, text, end):
    """The log probability of a text, one id at a time, in double precision and plain loops."""
    p = {k: v.astype(float) for k, v in attention.view(m["flat"], m["emb"].shape[1], m["last"].shape[0]).items()}
    branch, goals = m["last"].shape[0], [*text, end]
    given, total = [end, *text], 0.0
    x = m["emb"].astype(float)[given]
    y = x @ p["qkv"]
    y[:, -1] = 1
    for i, goal in enumerate(goals):
        low = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
        w = [math.exp(y[i, : attention.KEYS] @ y[j, attention.KEYS : 2 * attention.KEYS] + p["dist"][i - j]) for j in range(low, i + 1)]
        a = sum(c * y[j, 2 * attention.KEYS :] for c, j in zip(w, range(low, i + 1))) / sum(w)
        z = x[i] + a[:-1] @ p["o"]
        z = z + np.maximum(z @ p["w1"] + p["b1"], 0) @ p["w2"]
        c1, c2, c3 = m["slots"][goal].tolist()
        for logits, c in (
            (z @ p["n1"] + p["c1"], c1),
            (np.maximum(z @ p["a2"] + p["e2"][:, c1], 0) @ p["n2"] + p["c2"][:, c1], c2),
            (np.maximum(z @ p["a3"] + p["e3"][:, c1] + p["f3"][:, c2], 0) @ p["n3"] + m["last"][:, c1 * branch + c2], c3),
        ):
            total += logits[c] - math.log(np.exp(logits).sum())
    return total


def random_model(seed=0, vocabulary=50, dim=8):
    rng = np.random.default_rng(seed)
    m = attention.init(vocabulary, dim, rng.integers(1, 100, vocabulary))
    m["flat"] += rng.standard_normal(len(m["flat"])).astype(np.float32) * 0.2
    return m


def test_scores_equal_a_plain_loop_and_batches_do_not_matter():
    rng, m = np.random.default_rng(1), random_model()
    texts = [rng.integers(0, 49, n) for n in (5, 40, 17, 0, 100, 31, 32, 33)]
    want = [plain(m, t.tolist(), 49) for t in texts]
    assert np.allclose(attention.score(m, texts, 49), want, rtol=1e-4)
    assert np.allclose(attention.score(m, texts, 49, step=2), want, rtol=1e-4)
    one = sum(math.exp(attention._levels(m, np.ones((1, 8), np.float32), np.array([k]))[0][0]) for k in range(50))
    assert 0.98 < one <= 1.0001  # ids share all probability but for places without an id


def test_gradients_by_differences():
    rng, m = np.random.default_rng(2), random_model(3)
    m = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in m.items()}
    given, goal, first = attention.layout([rng.integers(0, 49, n) for n in (5, 40, 17, 0)], 49)
    _, flat, ids, emb = attention.gradients(m, given, goal, first)

    def slope(a, at, e=1e-5):
        old = a[at]
        a[at] = old + e
        up = attention.gradients(m, given, goal, first)[0]
        a[at] = old - e
        down = attention.gradients(m, given, goal, first)[0]
        a[at] = old
        return (up - down) / 2 / e

    parts, own = attention.view(m["flat"], 8, 4), attention.view(flat, 8, 4)
    for name in parts:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in parts[name].shape)
            if name == "qkv" and at[1] == parts[name].shape[1] - 1:
                continue  # replaced by the constant
            assert abs(slope(parts[name], at) - own[name][at]) < 1e-6 + 1e-3 * abs(own[name][at]), name
    for k in range(0, len(ids), 7):
        assert abs(slope(m["emb"], (ids[k], 3)) - emb[k, 3]) < 1e-6 + 1e-3 * abs(emb[k, 3])
