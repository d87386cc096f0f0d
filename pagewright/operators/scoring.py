"""Evaluation of maps and kinds against known truth: joins, shares and order statistics over result tables.

Cases. Empty inputs give empty results (or counts of 0); null truth or prediction is a value of its own in counts and
never right. Ties are broken by the columns named last.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, overlap

TOLERANCE, COVER, CUT = 1.0, 0.9, 0.4


def _b(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def _area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def band(confidence: Column) -> Column:
    """The lower edge of a confidence's band."""
    return F.when(confidence >= 0.9, "0.9").when(confidence >= 0.7, "0.7").when(confidence >= 0.5, "0.5").otherwise("0.0")


def calibration(predicted: DataFrame) -> DataFrame:
    """Predictions and right ones by band of confidence."""
    return predicted.groupBy(band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("n_right"))


def has_text_calibration(predicted: DataFrame) -> DataFrame:
    """A15 for yes-no predictions: has_text held from 0.5 on, sure as it is far from the middle."""
    h = F.col("has_text")
    return predicted.groupBy(band(F.greatest(h, 1 - h)).alias("band")).agg(F.count("*").alias("n"), F.count_if((h >= 0.5) == F.col("truth").cast("boolean")).alias("n_right"))


def confusion(predicted: DataFrame) -> DataFrame:
    """A16"""
    return predicted.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def coverage_rollup(pages: DataFrame, group: str, coverage: str) -> DataFrame:
    """For each group and for all (null): pages at the thresholds, median and worst coverage."""
    c = F.col(coverage)
    return pages.rollup(group).agg(
        F.count("*").alias("n"), F.count_if(c >= 1).alias("whole"), F.count_if(c >= 0.999).alias("over_999"), F.count_if(c >= 0.995).alias("over_995"), F.median(c).alias("median"), F.min(c).alias("worst")
    )


def hash_split(items: DataFrame, key: str) -> DataFrame:
    """Held out where the first byte of the key's hash is odd."""
    first = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int")
    return items.select(key, F.when(first % 2 == 1, "heldout").otherwise("tune").alias("split"))


def percentiles(values: DataFrame, group: str, value: str) -> DataFrame:
    """The values at places n / 2 and 0.9 n, rounded down, of each group's sorted values, and the largest."""
    w = Window.partitionBy(group)
    r = values.select(group, value, F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("rn") == F.least(F.col("n"), F.floor(F.col("n") * q) + 1), F.col(value)))
    return r.groupBy(group).agg(at(0.5).alias("median"), at(0.9).alias("p90"), F.max(value).alias("worst"))


def output_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: rows of one output that the other lacks, counted as often as they are lacking."""
    return old.exceptAll(new).select(F.lit("missing").alias("side"), "*").union(new.exceptAll(old).select(F.lit("new").alias("side"), "*"))


def frozen_diff(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, digest) lists -> (name, state MISSING, CHANGED or NEW) where they differ."""
    j = frozen.select("name", F.col("digest").alias("was")).join(now.select("name", F.col("digest").alias("is")), "name", "full_outer")
    state = F.when(F.col("is").isNull(), "MISSING").when(F.col("was").isNull(), "NEW").when(F.col("was") != F.col("is"), "CHANGED")
    return j.select("name", state.alias("state")).where("state is not null")


def _same(keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"{prefix}{k}")
    return on


def _touching(b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    o = b.select(*(F.col(k).alias(f"o_{k}") for k in (*keys, "x0", "y0", "x1", "y1")))
    touch = (F.col("o_x0") < F.col("x1")) & (F.col("o_x1") > F.col("x0")) & (F.col("o_y0") < F.col("y1")) & (F.col("o_y1") > F.col("y0"))
    return o, _same(keys, "o_") & touch


def without(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes of a that touch no box of b with the same keys."""
    o, on = _touching(b, keys)
    return a.join(o, on, "left_anti")


def touched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes of a that touch a box of b with the same keys."""
    o, on = _touching(b, keys)
    return a.join(o, on, "left_semi")


def covers(regions: DataFrame, truths: DataFrame, keys: Sequence[str], region: str) -> DataFrame:
    """For each region, the truths it touches and whether it covers COVER of one."""
    o, on = _touching(truths, keys)
    covered = 10 * overlap(_b(), _b("o_")) >= 9 * _area(_b("o_"))
    return regions.join(o, on).groupBy(*keys, region).agg(F.bool_or(covered).alias("covered"), F.count("*").alias("touching"))


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], slack: float) -> DataFrame:
    """Pairs of boxes of which one lies in the other, give or take the slack. Columns of outer get the prefix o_."""
    o = outer.select(*(F.col(k).alias(f"o_{k}") for k in outer.columns))
    fits = (F.col("x0") >= F.col("o_x0") - slack) & (F.col("y0") >= F.col("o_y0") - slack) & (F.col("x1") <= F.col("o_x1") + slack) & (F.col("y1") <= F.col("o_y1") + slack)
    return inner.join(o, _same(keys, "o_") & fits)


def edge_error(a: Box, b: Box) -> Column:
    return F.greatest(*(F.abs(p - q) for p, q in zip(a, b)))


def one_to_one(marks: DataFrame, found: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """Marks (keys, mark, what, box) and regions (keys, region, what, box) paired greedily by the largest edge error,
    then mark, then region: (keys, mark, region, error) of pairs within the tolerance. A page's pairs are one group."""
    r = found.select(*(F.col(k).alias(f"r_{k}") for k in (*keys, "region", "what", "x0", "y0", "x1", "y1")))
    near = marks.join(r, _same((*keys, "what"), "r_")).withColumn("error", edge_error(_b(), _b("r_"))).where(F.col("error") <= within)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("error", "ascending"), ("mark", "ascending"), ("region", "ascending")])
        a, b, keep = set(), set(), []
        for k, (m, g) in enumerate(zip(t["mark"].to_pylist(), t["region"].to_pylist())):
            if m not in a and g not in b:
                a.add(m)
                b.add(g)
                keep.append(k)
        return t.take(pa.array(keep, pa.int64()))

    cols = [*(F.col(k).cast("long") for k in (*keys, "mark")), F.col("r_region").cast("long").alias("region"), F.col("error").cast("double")]
    return near.select(*cols).groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} long" for k in (*keys, "mark", "region")), "error double"]))


def edge_errors(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Worst and median (the upper one) edge error by kind and flags."""
    s = pairs.groupBy(*by).agg(F.array_sort(F.collect_list("error")).alias("e"))
    return s.select(*by, F.size("e").alias("n"), F.element_at("e", (F.floor(F.size("e") / 2) + 1).cast("int")).alias("median"), F.element_at("e", -1).alias("worst"))


def majority(votes: DataFrame, by: Sequence[str], vote: str, order: str, confidence: str) -> DataFrame:
    """The most common vote of each group, the one seen first of equals, and the most confident one of that kind."""
    n = votes.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(confidence).alias(confidence))
    return n.groupBy(*by).agg(F.max_by(F.struct(vote, confidence), F.struct("n", -F.col("first"))).alias("m")).select(*by, f"m.{vote}", f"m.{confidence}")


def largest(boxes: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The largest box of each group, the first of equals."""
    best = F.max_by(F.struct(*(c for c in boxes.columns if c not in by)), F.struct(_area(_b()), -F.col(order)))
    return boxes.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def page_max(images: DataFrame, labels: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """A page's best image score beside its label; 0 where a labelled page has no image."""
    m = images.groupBy(*by).agg(F.max(score).alias(score))
    return labels.join(m, list(by), "left").fillna(0.0, [score])


def merged_truth(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """A merged image is text if any of its strips is text or unsure."""
    return parts.groupBy(*by).agg(F.when(F.bool_or(F.col("label").isin("text", "unsure")), "text").otherwise("none").alias("label"))


def missed_by_kind(missed: DataFrame) -> DataFrame:
    """Missed ink (n, near_text, near_image, near_vector, near_annot) by the first kind that is near."""
    kind = F.when(F.col("near_text"), "text").when(F.col("near_image"), "image").when(F.col("near_vector"), "vector").when(F.col("near_annot"), "annot").otherwise("other")
    return missed.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def phantoms(regions: DataFrame, ink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regions by kind in which there is no ink."""
    return without(regions, ink, keys).groupBy("what").agg(F.count("*").alias("n"))


def flags_missing(pairs: DataFrame) -> DataFrame:
    """Pairs whose expected flags aren't all among the found ones."""
    return pairs.where(F.size(F.array_except("expected", "flags")) > 0)


def cut_sweep(regions: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Regions (confidence, expected boolean) flagged and rightly flagged at each cut."""
    c = F.explode(F.array(*(F.lit(float(x)) for x in cuts))).alias("cut")
    flagged = F.col("confidence") >= F.col("cut")
    return regions.select("confidence", "expected", c).groupBy("cut").agg(F.count_if(flagged).alias("flagged"), F.count_if(flagged & F.col("expected")).alias("hits"), F.count_if(~flagged & F.col("expected")).alias("misses"))


def counting_word(text: Column, confidence: Column) -> Column:
    """F8: sure enough, and three letters or two digits."""
    letters, digits = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return (confidence >= 60) & ((letters >= 3) | (digits >= 2))


def worst(pages: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """L2 and L4: the first n rows by the order named."""
    return pages.orderBy(*by).limit(n)


def stratified(rows: DataFrame, stratum: str, key: str, each: int, seed: int = 1) -> DataFrame:
    """Up to `each` rows of a stratum by hash order, the same ones every time."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= each).drop("_rank")


def first_of_each(pieces: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each object once, where it is drawn first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pieces.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def placed_once(images: DataFrame, truth: DataFrame, keys: Sequence[str], within: float = TOLERANCE) -> DataFrame:
    """For each known placement, how many images lie within the tolerance of it; it is right with exactly one."""
    i = images.select(*(F.col(k).alias(f"i_{k}") for k in (*keys, "x0", "y0", "x1", "y1")))
    return truth.join(i, _same(keys, "i_") & (edge_error(_b(), _b("i_")) <= within), "left").groupBy(*keys).agg(F.count("i_x0").alias("n")).withColumn("right", F.col("n") == 1)
