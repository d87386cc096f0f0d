"""The pipeline: its stages one after another, each on what the one before kept."""

import importlib

import corpus_pipeline
import numpy as np
from pagewright.llm import rules

NAMES = ["quality_classifier", "quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def corpus():
    rng = np.random.default_rng(8)
    text = lambda n=90: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    shared = text(30)
    rows = [(k, text() + "\n" + text(60)) for k in range(30)]
    rows += [(40, rows[0][1]), (41, rows[1][1] + " end")]  # an exact copy, a near one
    rows += [(42, text() + "\n" + shared), (43, text() + "\n" + shared)]  # a line of two documents
    rows += [(44, None), (45, ""), (46, "too short"), (47, "same same same " * 40)]
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows]


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != NAMES[-1]:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in at.collect()}
    all_of = {r[0]: r[1] for r in corpus()}
    assert set(kept["quality_classifier"]) == set(all_of)  # no labels: nothing is rejected
    passed = {k for k, t in all_of.items() if not rules.base_failed(rules.measure(t or "")[0][0], rules.measure(t or "")[0][4])}
    assert set(kept["quality_rules"]) == passed and 46 not in passed and 47 not in passed
    lines = kept["line_dedup"]
    assert set(lines) == passed and lines[40].text == "" and lines[43].text == all_of[43].split("\n")[0] and lines[42].text == all_of[42]
    assert lines[41].text == "" and all(r.n_chars == len(r.text) for r in lines.values())  # alike by its shingles
    near = kept["simhash_near_dedup"]
    assert set(near) == passed - {41}  # 40 and 41 lost all lines and are one group
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(near)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in at.collect())


def test_the_entry_module_names_it():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in entry.queries()}
