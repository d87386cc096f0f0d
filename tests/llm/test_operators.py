"""Small tables with nulls, empty, long and repeated texts and clashing columns, against brute force."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pagewright.llm import bpe, html, lines, lm, packing, quality, rules, simhash, sketch, token_store
from pagewright.llm.common import Scratch

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(9000)) + "\n" + "a" * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it again"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it again"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from it AGAIN"),
    (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "two words"), (9, LONG), (10, LONG.replace("w5x5", "other")),
    (11, "first line of some length\nsecond line of some length\n\nfirst line of some length"), (11, "first line of some length"),
    (None, "a text without an id\nsecond line of some length"), (12, "  leading, double  spaces\t\tand 日本語 é!! 's 12345"), (-5, "minus"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, line string, kept string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, None if d == 7 else "en", "s1" if (d or 0) % 2 else None, len(t or ""), 1, "x", "y", None) for d, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, None), (None, 1, 1), (9, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(docs, none):
    assert simhash.simhash_components(none).collect() == []
    got = simhash.simhash_components(docs).collect()
    fps = [(d, simhash.fingerprint(t)) for d, t in TEXTS]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    names = {f for _, f in fps}
    root = closure(names, [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 2])
    want = sorted((str(d), f"{f:016x}", str(min((x for x, g in fps if root[g] == root[f] and x is not None), default=None))) for d, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


def test_covering_masks_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        flips = sum(1 << int(k) for k in rng.choice(64, 2, replace=False))
        assert any(not flips & m for m in simhash.masks(2))


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (12, 2))} | set(base))
    table = spark.createDataFrame([(f, f) for f in fps], "fp long, node long")
    got = [(r.a, r.b) for r in simhash.links(Scratch(spark), table).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    assert closure(fps, got) == closure(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def test_packing(docs, none):
    path = P.path("byte_bpe_50k.json")
    assert packing.pack(none, path).collect() == []
    got = packing.pack(docs, path).collect()
    ids = [(d, [*TIK.encode_ordinary(t or ""), 2]) for d, t in TEXTS]
    want = []
    for d, x in ids:
        starts = [0, *range((len(x) - 1) % 1024 + 1, len(x), 1024)]
        want += [(str(d), k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_capacity(rule):
    cap = packing.Capacity(tokens=100, max_docs=4, max_attention=6000, rule=rule)
    histogram = {int(k): int(n) for k, n in zip(range(1, 71), np.random.default_rng(1).integers(0, 50, 70))}
    runs, bins = packing.plan(histogram, cap), {}
    for size, rs in runs.items():
        assert sum(n for _, n, _, _ in rs) == histogram[size] and [r[0] for r in rs] == sorted(r[0] for r in rs)
        for _, n, first, offset in rs:
            for k in range(n):
                bins.setdefault(first + k, []).append((offset, size))
    for x in bins.values():
        assert len(x) <= 4 and sum(s * s for _, s in x) <= 6000 and sum(s for _, s in x) <= 100
        assert [o for o, _ in sorted(x)] == list(np.cumsum([0, *(s for _, s in sorted(x))])[:-1])


def test_token_files(spark, docs, none):
    path, scratch = P.path("byte_bpe_50k.json"), Scratch(spark)
    assert token_store.document_places(scratch, token_store.write_dataset(scratch, none, path, 0)).collect() == []
    rows = token_store.document_places(scratch, token_store.write_dataset(scratch, docs, path, 0, ids_a_file=500)).collect()
    ids = {}
    for d, t in TEXTS:
        x = [*TIK.encode_ordinary(t or ""), 0]
        ids.setdefault(d, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, *sorted(d for d, _ in TEXTS if d is not None)]


def test_value_coding():
    v = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], "<u4")
    for n in range(len(v) + 1):
        assert (token_store.read_values(*token_store.write_values(v[:n]), n) == v[:n]).all()


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.round_trip(none, path).collect() == []
    got = bpe.round_trip(docs, path).collect()
    want = sorted((str(d), np.array(TIK.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in TEXTS)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_bpe_tree_on_odd_strings():
    coder, rng = bpe.coder_of(P.path("byte_bpe_50k.tiktoken")), np.random.default_rng(5)
    for unit in ["a", "ab", "the", "=-", "日本", "\n", " ", "tion", "0"]:
        for n in (1, 2, 7, 33, 200, 1111):
            text = unit * n
            assert [i for m in coder.coder.findall(text) for i in coder.encode(m.encode())] == TIK.encode_ordinary(text)
    raw = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    assert coder.encode(raw) == TIK._core_bpe.encode_single_piece(raw) and coder.decode(coder.encode(raw)) == raw


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketches(spark, docs, none):
    assert sketch.edited_pairs(Scratch(spark), none).collect() == []
    order = sorted(((d, t or "") for d, t in TEXTS if d is not None), key=lambda x: (x[0], x[1].encode()))
    pairs = [(d, t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)] + [(d, t or "", "") for d, t in TEXTS if d is None]
    want = sorted((str(d), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for d, t, n in pairs)
    got = sketch.edited_pairs(Scratch(spark), docs).withColumn("near", sketch.likeness(sketch.F.col("sk"), sketch.F.col("edited_sk"))).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[1].sk == by[2].sk == by[3].sk and by[4].sk == by[5].sk == by[6].sk == []
    t = dict(TEXTS)[9]
    edited = t[: len(t) - len(t) // 2] + dict(TEXTS)[10][: len(t) // 2]
    true = len(shingles(t) & shingles(edited)) / len(shingles(t) | shingles(edited))
    assert abs(by[9].near - true) < 0.1


def test_successors(spark):
    ids = [-(1 << 62), -5, 0, 1, 2, 511, 512, 513, 40_000, 1 << 40, (1 << 62) + 3]
    got = dict(sketch.successors(spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert got == dict(zip(ids, [*ids[1:], ids[0]]))


def test_rules(docs, none, labels):
    assert rules.quality_rules(none, labels).collect() == []
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        t = [t or "" for d, t in TEXTS if d == r.doc_id]
        assert r.n_words in {len(x.split()) for x in t} and (r.kept == (not r.base_failed))
    assert rules.kept_documents(docs, labels).columns == docs.columns


def test_cutoffs_hold_the_risk():
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)
    assert rules.upper_bound(5, 5, 0.05) == 1.0
    k = rules.most_rejected(2000, 0.02, 0.01)
    assert rules.upper_bound(k, 2000, 0.01) <= 0.02 < rules.upper_bound(k + 1, 2000, 0.01)
    bins, good, bad = np.arange(5), np.array([900, 99, 1, 0, 0]), np.array([0, 0, 10, 40, 50])
    assert rules.choose(bins, good, bad, 0.05, 0.01) == 1
    assert rules.choose(bins, good, bad, 0.0001, 0.01) is None
    assert rules.choose(bins, good, bad * 0, 0.05, 0.01) is None


def test_classifier(spark, docs, none, labels):
    assert quality.quality_classifier(none, labels).collect() == []
    assert quality.quality_classifier(docs, labels).count() == len(TEXTS)
    assert quality.quality_classifier(docs, labels.limit(0)).where("kept").count() == len(TEXTS)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        words = rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"], 60).tolist() + (["spam"] * 3 if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", f"h{k % 5}", 0, int(not bad), 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    train = table.where("doc_id < 200").select("doc_id", "quality", "toxic")
    got = {r.doc_id: r.kept for r in quality.quality_classifier(table.drop("quality", "toxic"), train).collect()}
    assert sum(got[r[0]] == bool(r[5]) for r in rows if r[0] >= 200) >= 95
    assert quality.kept_documents(docs, labels).columns == docs.columns


def test_lines(docs, none):
    assert lines.deduplicated(none).collect() == []
    out = lines.deduplicated(docs, recount="n_chars")
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    at = {}
    for d, t in TEXTS:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip():
                at.setdefault(x.strip(), []).append((d if d is not None else -(1 << 63), p, d, t))
    names = sorted(at)
    root = closure(names, [(a, b) for a in names for b in names if a < b and lines.jaccard(a, b) >= 0.8])
    got = out.collect()
    kept = [(x.strip()) for r in got for x in (r.text or "").split("\n") if x.strip()]
    assert Counter(root[x] for x in kept).most_common(1)[0][1] == 1 and {root[x] for x in kept} == set(root.values())
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_full_bucket_of_lines(spark):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("abcdefghij "), 400))
    texts = [base]
    for _ in range(60):  # each changed a little from the one before: the ends are far from each other
        k = int(rng.integers(0, 380))
        texts.append(texts[-1][:k] + "".join(rng.choice(list("klmnop"), 6)) + texts[-1][k + 6 :])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(bool(r.text) for r in lines.deduplicated(table).collect()) == 1


def test_html(spark):
    page = (
        "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='box'>Same on all</div><article><h1>T &amp; U</h1>"
        "<p>Text number {0} <b>bold</b><br>more<p>Second&nbsp;  {0}<form>f</form><section id=comments>no</section></article><footer>c</footer></body></html>"
    )
    rows = [(k, f"https://h.example/{k}", page.format(k)) for k in range(12)] + [(12, None, None), (13, "x", ""), (None, "https://h.example/", "a < b <p>c"), (14, "https://o.example", "<div>one</div>two<script>x</script>")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "T & U\n\nText number 3 bold more\n\nSecond 3" and got[3].n_chars == len(got[3].text)
    assert got[12].text == got[13].text == "" and got[None].text == "a < b\n\nc" and got[14].text == "one\n\ntwo"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_style_tree_removes_boxes_that_do_not_change(spark):
    page = "<body><div class=x1>Subscribe now</div><div class=post7>Words that differ {0} {0}</div></body>"
    rows = [(k, "https://h.example/", page.format(k)) for k in range(20)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Words that differ {k} {k}" for k in range(20)}


def test_lm(docs, none, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_IDS", 1)
    monkeypatch.setattr(lm, "HOT_WORDS", 8)
    path = P.path("byte_bpe_50k.json")
    assert lm.scores(none, path).collect() == []
    got = lm.scores(docs, path).collect()
    words = [(d, [*(t or "").encode().lower().split(), None]) for d, t in TEXTS]
    count = Counter(w for d, x in words if not lm.is_held_out(d) for w in x)
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(d), len(x), sum(count[w] > 0 for w in x), round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in x), 6)) for d, x in words)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == total for r in got)
