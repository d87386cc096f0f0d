"""Linking of fuzzy lines: recall of the bands, and full buckets in blocks, against brute force."""

import re

import numpy as np
from pagewright.llm import lines
from pagewright.llm.common import Scratch


def cloud(rng, n, length, most):
    base = rng.choice(list("abcdefghij "), length)
    out = []
    for _ in range(n):
        x = base.copy()
        for at in rng.integers(0, length - 6, int(rng.integers(1, most))):
            x[at : at + 4] = rng.choice(list("klmnopq"), 4)
        out.append("".join(x))
    return out


def closure(names, linked):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_bands_recall_at_the_likeness():
    rng, met, n = np.random.default_rng(3), 0, 0
    while n < 300:
        a, b = cloud(rng, 2, 240, 5)
        if 0.8 <= lines.jaccard(a, b) <= 0.86:
            n += 1
            met += bool((lines.band_keys([a]) == lines.band_keys([b])).any())
    assert met / n >= 0.95


def test_blocks_lose_no_candidate(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 7)
    rng = np.random.default_rng(4)
    texts = [x for k in range(3) for x in cloud(rng, 60, 200, 7)] + ["alone in the world", "b" * 3000]
    keys = {t: set(k) for t, k in zip(texts, lines.band_keys(texts).tolist())}
    pairs = [(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b] and lines.jaccard(a, b) >= 0.8]
    root = closure(list(keys), pairs)
    true = closure(list(keys), [(a, b) for a in keys for b in keys if a < b and lines.jaccard(a, b) >= 0.8])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    scratch = Scratch(spark)
    distinct = scratch.table(lines.occurrences(docs).groupBy("line").agg(lines.F.max("bands").alias("bands")))
    got = {bytes(r.node): bytes(r.component) for r in lines.links(scratch, docs, distinct).collect()}
    name = {lines._name(t): t for t in texts}
    mine = {t: name[got.get(lines._name(t), lines._name(t))] for t in keys}
    same = lambda m: {frozenset(x for x in keys if m[x] == c) for c in set(m.values())}
    assert all(mine[a] == mine[b] for a, b in pairs)  # no candidate is lost
    assert all(len({true[x] for x in g}) == 1 for g in same(mine))  # no link is made up
    assert len(set(root.values())) > 5  # some lines stay outside


def test_common_counts_by_brute_force():
    rng = np.random.default_rng(5)
    values = [np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in (1, 40, 5000, 9000, 12_000)]
    outside = np.array([True, False, True, True, False])
    want = [[len(np.intersect1d(values[x], v)) for v in values] for x in np.flatnonzero(outside)]
    assert (lines._common(values, outside) == np.array(want)).all()


def test_common_leaves_out_what_a_line_has_alone():
    values = [np.arange(k * 10_000, k * 10_000 + 300, dtype=np.uint64) for k in range(6)] + [np.arange(200, 10_100, dtype=np.uint64)]
    outside = np.array([True, True, False, True, False, False, True])
    want = [[len(np.intersect1d(values[x], v)) for v in values] for x in np.flatnonzero(outside)]
    assert (lines._common(values, outside) == np.array(want)).all()
    assert (lines._common(values[:1], np.array([True])) == [[300]]).all()


def test_a_large_group_is_a_row_for_each_line(spark):
    rng = np.random.default_rng(6)
    texts = sorted(set(cloud(rng, 600, 200, 12)))
    keys = [bytes([k >> 8, k & 255]) for k in range(len(texts))]
    rows = [(b"l", n, 0.5, len(t), n, len(texts), sum(map(len, texts)), k > 0) for k, (n, t) in enumerate(zip(keys, texts))]
    groups = spark.createDataFrame(rows, "l binary, line binary, j double, m long, c binary, n long, w long, outside boolean")
    bodies = spark.createDataFrame(list(zip(keys, texts)), "line binary, body string")
    got = lines.blocks(groups, bodies)
    plan = got._jdf.queryExecution()
    linked = closure(keys, [(bytes(r.a), bytes(r.b)) for r in got.collect()])
    values = [set(lines.shingle_values([t])[0].tolist()) for t in texts]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert linked == closure(keys, [(keys[a], keys[b]) for a in range(len(keys)) for b in range(a) if like(values[a], values[b])])
    made = [int(x) for x in re.findall(r"Join .*?rows (\d+)", joined_rows(plan))]
    assert made and max(made) <= len(texts)


def joined_rows(plan):
    """A line for each join with a condition on line, with the rows it made."""
    todo, out = [plan.executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        name = p.nodeName()
        if name.endswith("QueryStage"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if name.endswith("Join") and "line" in p.simpleString(200).split("], [")[0]:
            out.append(f"Join rows {p.metrics().apply('numOutputRows').value()}")
    return "\n".join(out)


def test_links_of_blocks_are_a_forest():
    rng = np.random.default_rng(7)
    texts = sorted(set(cloud(rng, 300, 200, 4)))
    own = [k // 3 for k in range(len(texts))]  # lines in components of three
    values, rows = lines.values_of(texts), [(k, c, c > 0) for k, c in enumerate(own)]
    sets = [set(v.tolist()) for v in values]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    known = [(k, 3 * c) for k, c in enumerate(own)]
    got = lines.block_links(rows, values)
    assert closure(range(len(texts)), known + got) == closure(range(len(texts)), known + alike)
    assert set(got) <= {*alike, *((b, a) for a, b in alike)}
    assert len(alike) > 1000 and len(got) < len(set(own))


def test_a_cloud_of_close_lines_gives_no_more_links_than_lines(spark):
    rng = np.random.default_rng(8)
    texts = sorted(set(cloud(rng, 500, 200, 4)))
    keys = [bytes([k >> 8, k & 255]) for k in range(len(texts))]
    rows = [(b"l", n, 0.5, len(t), n, len(texts), sum(map(len, texts)), k > 0) for k, (n, t) in enumerate(zip(keys, texts))]
    groups = spark.createDataFrame(rows, "l binary, line binary, j double, m long, c binary, n long, w long, outside boolean")
    got = lines.blocks(groups, spark.createDataFrame(list(zip(keys, texts)), "line binary, body string")).collect()
    values = [set(v.tolist()) for v in lines.values_of(texts)]
    alike = [(keys[a], keys[b]) for a in range(len(keys)) for b in range(a) if len(values[a] & values[b]) >= 0.8 * len(values[a] | values[b])]
    assert len(alike) > 5 * len(texts) and len(got) < len(texts)
    assert closure(keys, [(bytes(r.a), bytes(r.b)) for r in got]) == closure(keys, alike)
