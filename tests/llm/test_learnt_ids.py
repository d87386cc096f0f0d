"""op7's ids are learnt from the corpus: few for its words, and none of a text is lost."""

import json

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pagewright.llm import attention, lm
from pagewright.llm.common import Scratch

PATH = P.path("byte_bpe_50k.json")
ODD = [" a  B\t\x0b\x0c\r\nc ", "", None, "  ", "É x y \x1c\x85Z", "one", "a\x00b \x1fq", "字 " * 3, "Xx" * 5000]


def words():
    rng, parts = np.random.default_rng(3), [b"th", b"ere", b"on", b"shly", b"tion", b"\xc3\xbcber", b"qu"]
    return {b"".join(parts[k] for k in rng.integers(0, 7, 4)): int(n) for n in rng.integers(1, 500, 900)}


def test_words_of_the_corpus_take_few_ids_and_any_text_has_its_bytes():
    own = words()
    source = lm.learnt(own, PATH)
    assert source == lm.learnt(dict(reversed(own.items())), PATH)
    ids = lm.encode([[w] for w in own], source)
    assert sum(map(len, ids)) < 0.5 * sum(map(len, lm.encode([[w] for w in own], PATH)))
    names = {v: k for k, v in json.loads(source)["vocab"].items()}
    assert sorted(names) == list(range(lm.VOCABULARY - 1))
    table = {ord(c): b for b, c in lm.byte_names().items()}
    for w in [*own, *(x for t in ODD for x in lm.words_of(t or "")), bytes(range(33, 256))]:
        got = "".join(names[k] for k in lm.encode([[w]], source)[0].tolist())
        assert bytes(table[ord(c)] for c in got) == b" " + w


def test_split_is_words_of():
    many = pa.array([" ".join(["w"] * (k % 30)) for k in range(700)])
    for texts in (many, many.slice(256, 256), many.slice(512), pa.array(ODD), pa.array(ODD).slice(2, 5), pa.array([], pa.string()), pa.array([None], pa.string())):
        got, n = lm.split(texts)
        want = [lm.words_of(t or "") for t in texts.to_pylist()]
        assert got.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]


def test_scores_are_those_of_texts_encoded_alone(spark, monkeypatch):
    seen = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "LEAST_IDS", 1)
    monkeypatch.setattr(lm, "fit", lambda scratch, rows, counts, source: seen.update(model=fit(scratch, rows, counts, source), source=source) or seen["model"])
    texts = [*ODD, *(" ".join(w.decode() for w in list(words())[k : k + 9]) for k in range(0, 90, 9))]
    got = lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), PATH).collect()
    own = lm.encode([lm.words_of(t or "") for t in texts], seen["source"])
    want = attention.score(seen["model"], own, lm.VOCABULARY - 1) / np.log(10)
    assert np.allclose([r.score for r in sorted(got, key=lambda r: r.doc_id)], want, rtol=1e-4)


def test_a_round_makes_no_more_sets_of_weights_than_it_has_parts(spark, monkeypatch):
    rows, kept, dropped, table, drop = {}, [], [], Scratch.table, Scratch.drop
    frame, by_key = type(spark.range(0)), type(spark.range(0)).repartition

    def counted(self, df, *a):
        out = table(self, df, *a)
        if "weight" in out.columns:
            rows[len(rows)] = out.count()
            kept.append(id(out))
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    monkeypatch.setattr(Scratch, "drop", lambda self, *t: dropped.extend(map(id, t)) or drop(self, *t))
    # as where a cluster deals out by a key to many partitions
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: by_key(self, max(n, 40) if cols and isinstance(n, int) else n, *cols))
    monkeypatch.setattr(lm, "LEAST_IDS", 1)
    texts = [" ".join(w.decode() for w in list(words())[k : k + 9]) for k in range(0, 400, 4)]
    got = lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), PATH).collect()
    assert len(got) == len(texts) and len(rows) == len(lm.ROUNDS) and set(rows.values()) <= {0, 1}  # few ids: a part each
    assert sorted(kept) == sorted(dropped)  # no weights stay on disk once they are averaged
