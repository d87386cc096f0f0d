"""Threshold-scaled document fingerprints, in DataFrame functions alone (operator 5).

A text's sketch keeps every distinct hash of its five-word shingles that lies below a fixed fraction of the hash
range. It grows with the text, so the sketches of a paragraph and of a book can be compared: below the threshold
both are complete. The union of two sketches is the sketch of the two texts' shingles together, overlap over union
estimates their Jaccard likeness, and overlap over a sketch's size the containment of that text in the other.

Cases. Words are lower-cased runs of non-white-space (ASCII white space). A null or blank text has the empty sketch,
whose likeness is 1 to itself and 0 to any other. Fewer than five words are one shingle. A text none of whose hashes
lies below the threshold keeps its smallest one, so no text with words is without evidence. Equal texts have equal
sketches. In `edited_pairs`, repeated doc_ids follow each other in the order of their texts; a row with a null doc_id
has no place in the order, and its next document is the empty text. Extra columns are ignored. An empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, read

#: hashes below 2^KEPT_BITS of 2^64 are kept: a quarter
WORDS, KEPT_BITS = 5, 62
BROADCAST_ROWS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        rolled = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words)))
        return F.when(n >= words, rolled).otherwise(F.array(F.xxhash64(w)))

    return let(clean, lambda c: F.when(c == "", F.array().cast("array<bigint>")).otherwise(let(F.split(c, "[ \\t-\\r]+"), hashes)))


def sketch(text: Column, words: int = WORDS, kept_bits: int = KEPT_BITS) -> Column:
    """Sorted distinct hashes (array of long) below 2^kept_bits, unsigned; else the smallest; empty without words."""
    flip = -(1 << 63)

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: (x >= 0) & (x < 1 << kept_bits))
        least = F.array_min(F.transform(h, lambda x: x.bitwiseXOR(F.lit(flip)))).bitwiseXOR(F.lit(flip))
        return let(low, lambda k: F.when((F.size(k) > 0) | (F.size(h) == 0), k).otherwise(F.array(least)))

    return F.array_sort(F.array_distinct(let(shingle_hashes(text, words), kept)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles; exact where neither sketch is a lone smallest hash above the threshold."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def successors(ids: DataFrame, bits: int = 9) -> DataFrame:
    """ids (id long, distinct) -> (id, next_id), the last one's being the first: by buckets of 2^bits, then over buckets.

    No task orders more than 2^bits ids, whatever their spread. Buckets are of unsigned ids, so that those of negative
    and other ids meet at last.
    """
    bucket = F.shiftrightunsigned(F.col("id").bitwiseXOR(F.lit(-(1 << 63))), bits)
    first = F.first("id").over(Window.partitionBy("b").orderBy("id"))
    rows = ids.withColumn("b", bucket).withColumn("n", F.lead("id").over(Window.partitionBy("b").orderBy("id"))).withColumn("f", first)
    firsts = rows.where("id = f").select("b", "f")
    if firsts.limit(2).count() < 2:
        return rows.select("id", F.coalesce("n", "f").alias("next_id"))
    over = successors(firsts.select(F.col("b").alias("id")), bits).select(F.col("id").alias("b"), F.col("next_id").alias("nb"))
    after = over.join(firsts.select(F.col("b").alias("nb"), F.col("f").alias("nf")), "nb").select("b", "nf")
    return rows.join(after, "b", "left").select("id", F.coalesce("n", "nf").alias("next_id"))


def with_next(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text, sk, next_text, next_sk), next in ascending doc_id, the first after the last.

    Rows move once, to their bucket of ids; the first document of each bucket goes to the bucket before as well.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    bits = min(14, max(9, n.bit_length() - 11))
    bucket = F.shiftright("doc_id", bits)
    firsts = scratch.table(docs.where("doc_id is not null").groupBy(bucket.alias("b")).agg(F.min("doc_id").alias("f")))
    order = scratch.table(successors(firsts.select(F.col("b").alias("id"))))
    sent = scratch.table(order.join(firsts, order.next_id == firsts.b).select("f", F.col("id").alias("before")))
    small = sent.count() <= BROADCAST_ROWS
    d = docs.join(F.broadcast(sent) if small else sent, docs.doc_id == sent.f, "left")
    own = F.struct(F.coalesce(bucket, -F.pmod(F.xxhash64("text"), F.lit(1 << 20)) - F.lit(1 << 62)).alias("bucket"), F.lit(False).alias("copy"))
    to = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    d = d.select("doc_id", "text", F.explode(to).alias("x")).select("doc_id", "text", "x.bucket", "x.copy")
    w = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    d = d.withColumn("next_text", F.lead("text").over(w)).withColumn("sk", sketch(F.col("text")))
    d = d.withColumn("next_sk", F.lead("sk").over(w)).where(~F.col("copy"))
    placed, none = F.col("doc_id").isNotNull(), F.array().cast("array<bigint>")
    return d.select("doc_id", "text", "sk", F.when(placed, F.col("next_text")).otherwise("").alias("next_text"), F.when(placed, F.col("next_sk")).otherwise(none).alias("next_sk"))


def edited_pairs(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sk, edited_sk, next_sk); the edited text ends with the start of the next document."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = with_next(scratch, docs).withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sk", sketch(F.col("edited")).alias("edited_sk"), "next_sk")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edited_pairs(Scratch(spark), read(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sk")).alias("fingerprint"), as_string(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
