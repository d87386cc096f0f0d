"""Quality rules with risk-controlled thresholds (operator 8).

Every rule compares one figure of a text with a cutoff. Cutoffs are chosen for each stratum (language) from all
labelled documents: a cutoff is valid if the exact (Clopper-Pearson) upper bound on the share of good documents that
it would reject is at most `risk` / rules, at a confidence of 1 - `delta` / (rules x strata) (Bonferroni). Cutoffs are
tested from the most lenient on and the first that fails ends the test (fixed sequence, which needs no further
correction). Of the valid ones the rule takes that with the largest share of bad documents rejected less good
documents rejected, the most lenient of equals. So with confidence 1 - delta, in no stratum are more than `risk` of
the good documents rejected. A stratum with too few labels for any valid cutoff, or without bad documents, gets none:
its documents are kept.

Figures are binned in thousandths, above FINE in steps of a thousandth of a doubling, so any two figures that differ by
0.07 % can be told apart, and there are at most FINE + 64,000 bins; labelled counts by stratum, rule and bin are grouped aggregates, so
labels may be any number. Good is quality = 1.

Cases. A null or blank text has no words and fails the base rule; a null stratum is a stratum of its own; repeated
labels count once each; labels with a null are left out; repeated documents are each judged. Without labels no rule
has a cutoff. Other columns are carried through unchanged by `kept_documents`, whatever their names. An empty table
stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from pagewright.llm.common import Scratch, drop_caches, packed, read, slices, texts_of

RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words", "capitals", "marks")
FINE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1].reshape(-1)
    _, which, count = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[which.reshape(-1)] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def figure_bin(x: float) -> int:
    """Rises with the figure."""
    n = math.ceil(1000 * x)
    return n if n <= FINE else FINE + 1 + int(1000 * math.log2(n / FINE))


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[int]]:
    """(the counts, the bin of each rule's figure)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    capitals = int(np.count_nonzero(np.frombuffer(raw, np.uint8) != np.frombuffer(raw.lower(), np.uint8)))
    each = max(n, 1)
    mean = chars / each
    figures = (symbols / each, dup / max(lines, 1), repeats / each, mean, max(0.0, 20 - mean), capitals / max(chars, 1), (raw.count(b"!") + raw.count(b"?")) / each)
    return (n, chars, symbols, dup, repeats), [figure_bin(x) for x in figures]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def measured(docs: DataFrame, *text: str) -> DataFrame:
    """docs with columns _m_n_words .. (long), _m_base_failed (boolean) and _m_figures (array of int) added."""
    extra = [StructField(f"_m_{c}", LongType()) for c in COUNTS] + [StructField("_m_base_failed", BooleanType()), StructField("_m_figures", ArrayType(IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for b in slices(batches):
            rows = [measure(t) for t in texts_of(b, *text)]
            cols = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            cols += [pa.array([base_failed(r[0][0], r[0][4]) for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *(x.name for x in extra)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which `rejected` or fewer of n have a chance of at least delta."""
    if rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)] if 0 < p < 1 else [0.0]
        top = max(terms)
        chance = math.exp(top) * sum(math.exp(t - top) for t in terms)
        lo, hi = (p, hi) if chance >= delta else (lo, p)
    return hi


def most_rejected(n: int, risk: float, delta: float) -> int:
    """The largest number of n good documents that may be rejected for the bound to stay at the risk; -1 if none."""
    lo, hi = -1, max(0, int(risk * n))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if upper_bound(mid, n, delta) <= risk else (lo, mid - 1)
    return lo


def choose(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int | None:
    """The cutoff, a bin above which texts are rejected; None for none. bins ascend; good and bad: documents in each."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return None
    limit = most_rejected(n_good, risk, delta)
    above_good, above_bad = n_good - np.cumsum(good), n_bad - np.cumsum(bad)
    valid = np.flatnonzero(above_good <= limit)
    gain = above_bad[valid] / n_bad - above_good[valid] / n_good
    if not len(valid) or gain.max() <= 0:
        return None
    return int(bins[valid[np.flatnonzero(gain == gain.max())[-1]]])


def cutoffs(measures: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """measures (doc_id, stratum, _m_figures), labels (doc_id, quality) -> (stratum, cuts map<int rule, int bin>)."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_l_id"), F.col("quality").alias("_l_quality"))
    rows = measures.select(F.col("doc_id").alias("_l_doc"), F.col(stratum).cast("string").alias("stratum"), F.posexplode("_m_figures").alias("rule", "bin"))
    rows = rows.join(known, F.col("_l_doc") == F.col("_l_id"))
    counts = rows.groupBy("stratum", "rule", "bin").agg(F.count_if(F.col("_l_quality") == 1).alias("good"), F.count_if(F.col("_l_quality") == 0).alias("bad"))
    scratch = Scratch(measures.sparkSession)
    counts = scratch.table(counts)
    strata = counts.select("stratum").distinct().count()
    tests = max(1, strata * len(RULES))

    def run(g: pa.Table) -> pa.Table:  # at most FINE + 64,000 rows
        g = g.sort_by("bin")
        cut = choose(*(g.column(k).to_numpy() for k in ("bin", "good", "bad")), risk / len(RULES), delta / tests)
        return g.slice(0, int(cut is not None)).select(["stratum", "rule"]).append_column("cut", pa.array([cut] if cut is not None else [], pa.int32()))

    each = counts.groupBy("stratum", "rule").applyInArrow(run, "stratum string, rule int, cut int")
    return scratch.table(each.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts")))


def judged(measures: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """measures with a column _m_kept: neither the base rule nor any rule of the stratum rejects."""
    cuts = cuts.select(F.col("stratum").alias("_m_stratum"), F.col("cuts").alias("_m_cuts"))
    over = F.exists(F.map_entries("_m_cuts"), lambda e: F.element_at("_m_figures", e["key"] + 1) > e["value"])
    out = measures.join(cuts, F.col(stratum).cast("string").eqNullSafe(F.col("_m_stratum")), "left")
    return out.withColumn("_m_kept", ~F.col("_m_base_failed") & ~F.coalesce(over, F.lit(False)))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """docs (doc_id, text, stratum) -> (doc_id, the counts, base_failed, kept), a row for each row."""
    scratch = Scratch(docs.sparkSession)
    m = scratch.table(measured(docs.select("doc_id", "text", stratum)).drop("text"))
    out = judged(m, cutoffs(m, labels, stratum, risk, delta), stratum)
    return out.select("doc_id", *(F.col(f"_m_{c}").alias(c) for c in COUNTS), F.col("_m_base_failed").alias("base_failed"), F.col("_m_kept").alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that the rules keep, with all of their columns. Texts are measured once and written with their figures."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(measured(packed(docs), "row", "text")).withColumn("_m_of", F.col(f"row.{stratum}"))
    m = rows.select(F.col("row.doc_id").alias("doc_id"), "_m_of", "_m_figures")
    return judged(rows, cutoffs(m, labels, "_m_of", risk, delta), "_m_of").where("_m_kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
