"""Where an operator has two ways, both give the same rows."""

import numpy as np
import public_tokenizers as P
from pagewright.llm import components, packing, sketch, token_store
from pagewright.llm.common import Scratch


def test_union_find_in_one_job_or_several(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(None, 3), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, components.components(Scratch(spark), table).collect()))
    monkeypatch.setattr(components, "SMALL", 0)
    assert sorted(map(tuple, components.components(Scratch(spark), table).collect())) == one
    root = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert one == sorted((n, find(n)) for n in linked if n != find(n))


def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 60)))) for k in rng.integers(0, 1 << 40, 80)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id"), (5, None)], "doc_id long, text string").repartition(3)


def test_successors_by_broadcast_or_join(spark, monkeypatch):
    d = docs(spark)
    get = lambda: sorted(map(str, sketch.edited_pairs(Scratch(spark), d).collect()))
    one = get()
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", 0)
    assert get() == one


def test_packing_in_few_or_many_parts(spark):
    d, path = docs(spark), P.path("byte_bpe_50k.json")
    for rows in (50_000, 1):
        got = packing.pack(d, path, rows_a_part=rows).collect()
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for x in by.values():
            ends = np.cumsum([n for _, n in sorted(x)])
            assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 1024
        pieces = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
        assert rows == 50_000 or pieces == first and len(by) == n
        first, n = pieces, len(by)


def test_files_of_few_or_many_parts(spark, monkeypatch):
    d, path = docs(spark), P.path("byte_bpe_50k.json")

    def places(**more):
        scratch = Scratch(spark)
        return sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_store.document_places(scratch, token_store.write_dataset(scratch, d, path, 0, **more)).collect())

    one = places()
    assert places(ids_a_file=100) == one
    monkeypatch.setattr(token_store, "MOST_PARTS", 2)
    assert places(ids_a_file=50) == one
