"""Quality classifier by hierarchical empirical Bayes (operator 2).

Document evidence. Two logistic models on the words a text has and on bins of its surface figures, one for quality
and one for toxicity, fitted to a sample of at most `max_labelled` labelled documents, the ones whose hashed ids are
smallest. The bound is a parameter; everything below covers all documents. Every feature of MIN_DOCS sample rows and
more takes part, scaled by its own log odds ratio, smoothed by a row of the class's rate: a word of a few rows of one
class counts, and the many rare words of both classes hardly do.

Site posteriors. A document counts in its host and path (a path is one of its host) with its model probability, and
where it has a label with that instead. A host's rate is its documents' mean shrunk towards the global rate, a path's rate
its mean shrunk towards its host's; the shrinkage weight is fitted to the spread of the sites' rates by the method of
moments, so a site with few documents takes its parent's rate and a large one its own. Sums by site are grouped
aggregates with partial sums. A document's own probability is taken out of its host's and path's sums before they judge
it, so its evidence counts once.

Decision. Log odds of the document plus those of its path's rate less those of the global rate. A document is kept if
quality is at least as likely as not and toxicity less likely than not.

Cases. A null text is blank; a blank text has no words and is judged by its figures. Null host or path: a site of its
own. Labels with a null are left out for that model; without labels of both classes a model is neutral and rejects
nothing. Repeated documents are each judged and counted. Repeated labels of a document count as one, the smallest.
Other columns are carried through unchanged by `kept_documents`. An empty table stays empty.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagewright.llm.common import Scratch, drop_caches, packed, read, slices, texts_of
from pagewright.llm.rules import measure

TARGETS = ("quality", "toxic")
STRIP = b".,;:!?\"'()[]{}*&%$#|<>"
MIN_DOCS = 2
Model = tuple[dict[bytes, tuple[float, float]], tuple[float, float]]


def features(text: str) -> set[bytes]:
    """The words of a text, lower-cased without outer marks, and its figures' bins (which hold a blank, as no word does)."""
    raw = text.encode("utf-8", "surrogatepass")
    counts, figures = measure(text)
    words = raw.lower().split()
    seen = {w.strip(STRIP) for w in set(words)}
    n = len(words)
    most = max(Counter(words).values()) if words else 0
    figures = [*figures, 1000 * len(seen) // max(n, 1), 1000 * most // max(n, 1), 1000 * sum(map(raw.count, b"0123456789")) // max(len(raw), 1), 200 * n.bit_length()]
    seen |= {b"%d %d" % (k, int((x / 10) ** 0.75)) for k, x in enumerate(figures)}
    return seen


def fit(rows: Iterable[tuple[Iterable[bytes], int | None, int | None]], steps: int = 120, ridge: float = 1.0) -> Model:
    """Logistic models of the targets over features that MIN_DOCS rows have; full-batch AdaGrad in numpy."""
    number: dict[bytes, int] = {}
    cols, targets = [], []
    for f, *t in rows:
        cols.append(np.array([number.setdefault(x, len(number)) for x in f], np.int32))
        targets.append(t)
    size, flat = np.array([len(c) for c in cols], np.int64), np.concatenate([*cols, np.zeros(0, np.int32)])
    kept = np.bincount(flat, minlength=len(number)) >= MIN_DOCS
    names = [f for f, k in number.items() if kept[k]]
    place = np.cumsum(kept) - 1
    del number, cols
    owner = np.repeat(np.arange(len(size)), size)[kept[flat]] if len(flat) else np.zeros(0, np.int64)
    flat = place[flat[kept[flat]]] if len(flat) else np.zeros(0, np.int64)
    weights, bias = np.zeros((len(names), 2)), [0.0, 0.0]
    for t in range(2):
        there = np.array([r[t] is not None for r in targets], bool)
        y = np.array([r[t] or 0 for r in targets], float)
        n, pos = there.sum(), y[there].sum()
        if not 0 < pos < n:
            bias[t] = 30.0 if t == 0 else -30.0  # neutral: rejects nothing
            continue
        rate, of, both = pos / n, np.bincount(flat, y[owner], len(names)), np.bincount(flat, there[owner], len(names))
        scale = np.abs(np.log((of + rate) / (both - of + 1 - rate) * (1 - rate) / rate))
        each = scale[flat]
        w, b, sq, sb = np.zeros(len(names)), float(np.log(pos / (n - pos))), np.full(len(names), 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(owner, w[flat] * each, len(size)) + b
            e = np.where(there, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0)
            g = np.bincount(flat, e[owner], len(names)) * scale + ridge * w
            sq += g * g
            sb += e.sum() ** 2
            w -= 0.3 * g / np.sqrt(sq)
            b -= 0.3 * e.sum() / np.sqrt(sb)
        weights[:, t], bias[t] = w * scale, b
    return {f: (float(a), float(b)) for f, (a, b) in zip(names, weights)}, (bias[0], bias[1])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int) -> bytes:
    """The pickled model, fitted in one task over at most max_labelled rows."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.min("toxic").alias("_t"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_labelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = [b"\n".join(sorted(features(t))) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(f, pa.binary()), b.column("_q").cast(pa.int32()), b.column("_t").cast(pa.int32())], ["doc_id", "f", "q", "t"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f.split(b"\n"), q, t) for b in slices(batches) for f, q, t in zip(*(b.column(k).to_pylist() for k in ("f", "q", "t"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.large_binary())], ["model"])

    once = rows.mapInArrow(run, "doc_id long, f binary, q int, t int").dropDuplicates(["doc_id"])
    got = once.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fitted, "model binary").collect()
    return bytes(got[0]["model"]) if got else pickle.dumps(fit([]))


def scored(docs: DataFrame, model: bytes, *text: str) -> DataFrame:
    """docs with the log odds _e_quality and _e_toxic of the text column (or field) added."""
    extra = [StructField(f"_e_{t}", DoubleType()) for t in TARGETS]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        (weights, bias), none = pickle.loads(shared.value), (0.0, 0.0)
        for b in slices(batches):
            out = []
            for t in texts_of(b, *text):
                got = [weights[f] for f in features(t) if f in weights] or [none]
                out.append(np.clip(np.array(bias) + np.sum(got, axis=0), -30, 30))
            cols = np.array(out).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[:, 0]), pa.array(cols[:, 1])], [*b.schema.names, *(x.name for x in extra)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _weight(sites: DataFrame, parent) -> dict[str, float]:
    """By target, the documents that the parent's rate weighs: p(1-p) over the variance between sites."""
    out = {}
    for t in TARGETS:
        p, q = parent(t), F.col(f"s_{t}") / F.col("n")
        square = F.col("n") * (q - p) * (q - p)
        r = sites.agg(F.sum(square).alias("a"), F.sum(p * (1 - p)).alias("b"), F.sum("n").alias("n"), F.sum(F.col("n") * p * (1 - p)).alias("v")).first()
        if not r["n"]:
            out[t] = 1.0
            continue
        between = max(0.0, (r["a"] - r["b"]) / r["n"])
        out[t] = float(min(1e6, max(1.0, (r["v"] / r["n"]) / between))) if between > 0 else 1e6
    return out


def _probability(odds):
    return 1 / (1 + F.exp(-odds))


def site_sums(scratch: Scratch, evidence: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """evidence (doc_id, h, p, _e_*) -> ((h, p, n, s_*, host_n, host_s_*) of every path, the global rates and shrinkage weights)."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_l_id")).agg(*(F.min(t).alias(f"_l_{t}") for t in TARGETS))
    rows = evidence.join(known, F.col("doc_id") == F.col("_l_id"), "left")
    mass = [F.coalesce(F.col(f"_l_{t}").cast("double"), _probability(F.col(f"_e_{t}"))) for t in TARGETS]
    paths = scratch.table(rows.groupBy("h", "p").agg(F.count("*").alias("n"), *(F.sum(m).alias(f"s_{t}") for m, t in zip(mass, TARGETS))))
    hosts = scratch.table(paths.groupBy(F.col("h").alias("hh")).agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS)))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(t) for t in TARGETS)).first()
    fitted: dict = {"base": {t: min(1 - 1e-6, max(1e-6, (total[t] or 0.0) / (total["n"] or 1))) for t in TARGETS}}
    fitted["host"] = _weight(hosts, lambda t: F.lit(fitted["base"][t]))
    hosts = hosts.select("hh", F.col("n").alias("host_n"), *(F.col(f"s_{t}").alias(f"host_s_{t}") for t in TARGETS))
    both = scratch.table(paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).drop("hh"))
    rate = lambda t: (F.col(f"host_s_{t}") + fitted["host"][t] * fitted["base"][t]) / (F.col("host_n") + fitted["host"][t])
    fitted["path"] = _weight(both, rate)
    return both, fitted


def judged(evidence: DataFrame, sums: DataFrame, fitted: dict) -> DataFrame:
    """evidence (h, p, _e_*, ..) with host_*, path_* (the posterior rates without the document's own evidence), _p_*, _kept."""
    sites = sums.withColumnsRenamed({"h": "_s_h", "p": "_s_p"})
    out = evidence.join(sites, F.col("h").eqNullSafe(F.col("_s_h")) & F.col("p").eqNullSafe(F.col("_s_p")), "left")
    for t in TARGETS:
        own, base = _probability(F.col(f"_e_{t}")), fitted["base"][t]
        m, k = fitted["host"][t], fitted["path"][t]
        less = lambda c, o=own: F.greatest(F.lit(0.0), F.col(c) - o)
        out = out.withColumn(f"host_{t}", (less(f"host_s_{t}") + m * base) / (F.col("host_n") - 1 + m))
        out = out.withColumn(f"path_{t}", (less(f"s_{t}") + k * F.col(f"host_{t}")) / (F.col("n") - 1 + k))
        out = out.withColumn(f"_p_{t}", _probability(F.col(f"_e_{t}") + _logit(F.col(f"path_{t}")) - _logit(F.lit(base))))
    return out.withColumn("_kept", (F.col("_p_quality") >= 0.5) & (F.col("_p_toxic") < 0.5))


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = 8000) -> DataFrame:
    """docs (doc_id, text, host, path) -> a row for each: doc_id, host, path, doc_*, host_*, path_*, *_score, kept."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.col(host).alias("h0"), F.col(path).alias("p0"))
    evidence = scored(docs, train(docs, labels, max_labelled), "text").drop("text")
    evidence = scratch.table(evidence.select("*", F.col("h0").cast("string").alias("h"), F.col("p0").cast("string").alias("p")))
    out = judged(evidence, *site_sums(scratch, evidence.select("doc_id", "h", "p", "_e_quality", "_e_toxic"), labels))
    return out.select(
        "doc_id", F.col("h0").alias(host), F.col("p0").alias(path), *(_probability(F.col(f"_e_{t}")).alias(f"doc_{t}") for t in TARGETS), *(f"{level}_{t}" for level in ("host", "path") for t in TARGETS),
        *(F.col(f"_p_{t}").alias(f"{t}_score") for t in TARGETS), F.col("_kept").alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = 8000) -> DataFrame:
    """The rows of docs that are kept, with all of their columns. Texts are scored once and written with their evidence."""
    scratch = Scratch(docs.sparkSession)
    model = train(docs.select("doc_id", "text"), labels, max_labelled)
    rows = scratch.table(scored(packed(docs), model, "row", "text"))
    rows = rows.select("*", F.col(f"row.{host}").cast("string").alias("h"), F.col(f"row.{path}").cast("string").alias("p"))
    evidence = rows.select(F.col("row.doc_id").alias("doc_id"), "h", "p", "_e_quality", "_e_toxic")
    return judged(rows, *site_sums(scratch, evidence, labels)).where("_kept").select("row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
