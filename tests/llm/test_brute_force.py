"""Operators against plain Python over small tables with nulls, empty and repeated texts and clashing columns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pagewright.llm import atoms, packing, quality, rules, simhash, sketch
from pagewright.llm.common import Scratch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(80)] + ["É", "ÀB", "#x", "A*", "wow!", "日本", "10%", "x|y"]
    out = [None, "", " \t\n", "one", "Two words", "a b c", "\x0b a\x0cb  c  d", "line\nline\n\nline \nother"]
    for _ in range(n):
        lines = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(rng.integers(1, 5))]
        out.append("\n".join(lines + lines[: rng.integers(0, 2)]))
    return out + out[8:12]


def plain_fingerprint(t):
    w = [lower(x) for x in WORD.findall(t or "")]
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash_fingerprints_from_the_definition(spark):
    ts = texts()
    got = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).collect()}
    assert all(got[k].fingerprint == f"{plain_fingerprint(t):016x}" for k, t in enumerate(ts))
    assert any(plain_fingerprint(t) >> 63 for t in ts)


def test_links_with_the_highest_bit(spark):
    rng = np.random.default_rng(4)
    fps = set()
    for b in rng.integers(0, 1 << 64, 25, dtype=np.uint64).tolist():
        fps |= {b} | {b ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (10, 2))} | {b ^ (1 << 63)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(f, f) for f in signed], "fp long, node long")
    root = {f: f for f in signed}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    def join(r, a, b):
        a, b = find(r, a), find(r, b)
        r[max(a, b)] = min(a, b)

    mask = (1 << 64) - 1
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & mask).bit_count() <= 2:
                join(root, a, b)
    mine = {f: f for f in signed}
    for r in simhash.links(Scratch(spark), table).collect():
        join(mine, r.a, r.b)
    assert {f: find(mine, f) for f in signed} == {f: find(root, f) for f in signed} and any(f < 0 for f in signed)


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + i for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_rules_over_a_table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(3600):
        bad = k % 4 < 2 and k % 8 < 2
        w = [f"w{x}" for x in rng.integers(0, 300, 60)] + ["!!!"] * (int(rng.integers(8, 20)) if bad else int(rng.integers(0, 3)))
        rng.shuffle(w)
        rows.append((k, " ".join(w), "en" if k % 2 else None, "x", int(not bad)))
    rows += [(9000 + k, t, "de", "x", None) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, `_m_kept.x` string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] is not None], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    cuts = {}
    for lang in (None, "en"):
        own = [(rules.measure(t)[1], q) for _, t, g, _, q in rows if g == lang and q is not None]
        for k in range(len(rules.RULES)):
            good, bad = sorted(f[k] for f, q in own if q == 1), sorted(f[k] for f, q in own if q == 0)
            best, limit = None, rules.most_rejected(len(good), 0.05 / len(rules.RULES), 0.05 / (2 * len(rules.RULES)))
            for cut in sorted({*good, *bad}):
                lost, hit = sum(x > cut for x in good), sum(x > cut for x in bad)
                gain = hit / len(bad) - lost / len(good)
                if lost <= limit and gain > 0 and (best is None or gain >= best[0]):
                    best = (gain, cut)
            if best:
                cuts[lang, k] = best[1]
    assert cuts
    for doc, t, lang, _, _ in rows:
        r, counts = got[doc], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        over = any(rules.measure(t or "")[1][k] > c for (g, k), c in cuts.items() if g == lang)
        assert r.base_failed == failed and r.kept == (not failed and not over)
    kept = rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)
    assert rules.figure_bin(25.0) < rules.figure_bin(26.0) < rules.figure_bin(1e6) and rules.figure_bin(19.999) == 19_999


def test_site_posteriors_leave_a_document_out(spark):
    rng = np.random.default_rng(2)
    rows = [(k if k % 17 else None, f"h{k % 4}" if k % 11 else None, f"p{k % 3}", float(rng.normal()), float(rng.normal() - 2)) for k in range(200)]
    ev = spark.createDataFrame(rows, "doc_id long, h string, p string, _e_quality double, _e_toxic double")
    labels = spark.createDataFrame([(k, int(k % 2), 0 if k % 5 else 1) for k in range(1, 60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    scratch = Scratch(spark)
    sums, fitted = quality.site_sums(scratch, ev, labels)
    got = quality.judged(ev, sums, fitted).collect()
    known = {k: {"quality": int(k % 2), "toxic": 0 if k % 5 else 1} for k in range(1, 60)}
    p = lambda e: 1 / (1 + math.exp(-e))
    for t, at in (("quality", 3), ("toxic", 4)):
        mass = [known[r[0]][t] if r[0] in known else p(r[at]) for r in rows]
        n, s, hn, hs = Counter(), defaultdict(float), Counter(), defaultdict(float)
        for r, m in zip(rows, mass):
            n[r[1:3]] += 1
            s[r[1:3]] += m
            hn[r[1]] += 1
            hs[r[1]] += m
        base, m, k = fitted["base"][t], fitted["host"][t], fitted["path"][t]
        assert base == pytest.approx(sum(mass) / len(mass))
        for r in got:
            own = p(r[f"_e_{t}"])
            host = (max(0, hs[r.h] - own) + m * base) / (hn[r.h] - 1 + m)
            path = (max(0, s[r.h, r.p] - own) + k * host) / (n[r.h, r.p] - 1 + k)
            cut = min(1 - 1e-6, max(1e-6, path))
            assert r[f"path_{t}"] == pytest.approx(path)
            assert r[f"_p_{t}"] == pytest.approx(p(r[f"_e_{t}"] + math.log(cut / (1 - cut)) - math.log(base / (1 - base))))


def test_classifier_keeps_any_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "s", "en", 1, 2), (2, None, None, None, 3, 4)], "doc_id long, text string, source string, lang string, `_e_quality` int, `a.b` int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.kept_documents(docs, labels)
    assert got.columns == docs.columns and sorted(tuple(r)[-2:] for r in got.collect()) == [(1, 2), (3, 4)]


def plain_sketch(t):
    w = [x.lower() for x in WORD.findall(t or "")]

    def h(ws):
        seed = 42
        for x in ws:
            seed = xxhash.xxh64_intdigest(x.encode(), seed=seed)
        return seed

    hs = [h(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [h(w)] if w else []
    return sorted({x for x in hs if x < 1 << 62} or ({min(hs)} if hs else set()))


def test_sketches_from_the_definition(spark):
    ts = [t or "" for t in texts()]
    rows = sketch.edited_pairs(Scratch(spark), spark.createDataFrame([(3 * k, t) for k, t in enumerate(ts)], "doc_id long, text string"))
    rows = rows.withColumn("near_edited", sketch.likeness(F.col("sk"), F.col("edited_sk"))).withColumn("near_next", sketch.likeness(F.col("sk"), F.col("next_sk"))).withColumn("held", sketch.containment(F.col("sk"), F.col("next_sk")))
    unsigned = lambda s: sorted(x & (1 << 64) - 1 for x in s)

    def like(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in rows.collect():
        k = r.doc_id // 3
        after = ts[(k + 1) % len(ts)]
        half = len(ts[k]) // 2
        edited = ts[k][: len(ts[k]) - half] + after[:half]
        a, b, c = plain_sketch(ts[k]), plain_sketch(edited), plain_sketch(after)
        assert unsigned(r.sk) == a and unsigned(r.edited_sk) == b
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert r.held == (pytest.approx(len(set(a) & set(c)) / len(a)) if a else None)


def test_packing_is_item_by_item_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cap = packing.Capacity(tokens=int(rng.integers(20, 120)), max_docs=int(rng.integers(2, 9)), rule=str(rng.choice(["norm", "dot"])))
        sizes = rng.integers(1, cap.tokens + 1, int(rng.integers(1, 150))).tolist()
        tokens, docs, attention = cap.limits
        wt = [w / (x * x) for w, x in zip(cap.weights, (tokens, docs, attention))]
        bins = []
        for n in sorted(sizes, reverse=True):
            fits = [(k, b) for k, b in enumerate(bins) if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
            norm = lambda b: wt[0] * (b[0] - n) ** 2 + wt[1] * (b[1] - 1) ** 2 + wt[2] * (b[2] - n * n) ** 2  # noqa: E731, B023
            dot = lambda b: -(wt[0] * n * b[0] + wt[1] * b[1] + wt[2] * n * n * b[2])  # noqa: E731, B023
            if fits:
                b = min(fits, key=lambda x: ((norm if cap.rule == "norm" else dot)(x[1]), x[1][0] - n, x[0]))[1]
            else:
                bins.append(b := [tokens, docs, attention])
            b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
        runs = packing.plan(dict(Counter(sizes)), cap)
        used = {first + k for rs in runs.values() for _, n, first, _ in rs for k in range(n)}
        assert len(used) == len(bins)


def test_ids_where_a_text_spells_an_added_token():
    path = P.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), atoms.tokenizers_encoder(path)
    rng, parts = np.random.default_rng(5), [*own.added, "a", " ", "  ", "word", " word", "\n", "é", "<|endof", "\t x"]
    ts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(500)]
    ids, at = own.encode_batch(ts)
    assert own.added and all(ids[at[k] : at[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids for k, t in enumerate(ts))
