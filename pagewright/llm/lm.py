"""Language-model scores of documents (operator 7).

Two scores in log10. The base is an add-one unigram over lower-cased words and an end. The model is the causal
self-attention of `attention` over subword ids: VOCABULARY - 1 ids of a byte-level vocabulary and an end. Its merges are
learnt from at most HOT_WORDS words that are met most in the training documents (up to TAUGHT_BYTES bytes long, each
shown by its share of about TAUGHT); this fixes only how a text is cut into ids, whole as it is. Where these words give fewer merges, the first ones of a public vocabulary follow. All 256 bytes are ids, so any
text has its ids. A text is its words, each with one blank before it; its score is the probability of the ids of these
and of the end.

What is learnt from the corpus. Words and subword ids are counted over all training documents, by partial sums. The
counts give the base, and the order and output biases of the model's choices. Its weights are learnt in ROUNDS. Each
training document belongs to one round by a hash of its id. A round's documents are dealt at random into parts of
about IDS_A_PART ids; each part trains on from the last round's weights over every block of its documents, and the
weights are averaged, those of an embedding by how often each part met its id. So every id of every training document
is a goal once (PASSES times at most in a corpus of less than LEAST_IDS ids, which would else have too few steps).
Over MOST_PARTS parts, parts get longer, so the weights that are averaged stay few.

Each text is encoded once: its ids, and what its words give to the base, are a row of a scratch table, from which
parts are dealt and scores are taken.

Scale. Words of a count of 2^j and more go to the workers as a dictionary, j being the least for which they are
HOT_WORDS at most; the other words of a document stay with its row and are joined with their counts, so no worker
holds the corpus's words. Only those words, weights, counts by id, and sums reach the driver, all of bounded number.

Cases. A null text is empty, and an empty one its end alone. A document with a null doc_id has the id text ''. Repeated
documents each count and are each returned. Extra columns are ignored. Without training documents all counts are zero
and the model has its initial weights. An empty table stays empty.
"""

from __future__ import annotations

import json
import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import attention
from pagewright.llm.atoms import byte_names
from pagewright.llm.common import Scratch, cache, read, slices, texts_of

VOCABULARY, DIM = 16384, 32
#: ends of the rounds in 64ths of the training documents
ROUNDS, IDS_A_PART, MOST_PARTS = (1, 8, 64), 2_000_000, 16384
LEAST_IDS, PASSES, RATE, CHUNK = 8_000_000, 20, 3e-3, 300_000
HOT_WORDS, CACHE = 1 << 17, 200_000
#: bytes of words that are counted at once
COUNTED_BYTES = 48_000_000
#: words that merges are learnt from: how often they are shown in all, and their longest
TAUGHT, TAUGHT_BYTES = 3_000_000, 64
_NAMES = str.maketrans({chr(b): c for b, c in byte_names().items() if b != 10})  # no word has a line feed


def named(word: bytes) -> str:
    """A word with a blank before it, a character for each byte."""
    return (b" " + word).decode("latin-1").translate(_NAMES)


def learnt(words: dict[bytes, int], path: str) -> str:
    """A vocabulary of VOCABULARY - 1 ids, as JSON: merges of the words by their counts, then the first of a tokenizer file."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    short = {w: n for w, n in sorted(words.items()) if len(w) <= TAUGHT_BYTES}
    share = max(1.0, sum(short.values()) / TAUGHT)
    own = Tokenizer(models.BPE())
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    trainer = trainers.BpeTrainer(vocab_size=VOCABULARY - 1, initial_alphabet=sorted(byte_names().values()), show_progress=False)
    own.train_from_iterator((f"{named(w)} " * math.ceil(n / share) for w, n in short.items()), trainer)
    spec = json.loads(own.to_str())["model"]
    vocabulary, merges = spec["vocab"], [tuple(m) for m in spec["merges"]]
    with open(path, encoding="utf-8") as f:
        more = json.load(f)["model"]["merges"]
    for m in more:
        if len(vocabulary) >= VOCABULARY - 1:
            break
        a, b = m.split(" ") if isinstance(m, str) else m
        if a in vocabulary and b in vocabulary and a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            merges.append((a, b))
    return json.dumps({"vocab": vocabulary, "merges": merges})


def coder(source: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Byte-level BPE of words, by a vocabulary that was learnt or by the first ids of a tokenizer file: (all ids, each word's number of ids)."""
    from tokenizers import models

    if source.startswith("{"):
        spec = json.loads(source)
        vocabulary, merges = spec["vocab"], spec["merges"]
    else:
        with open(source, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocabulary = {k: v for k, v in spec["vocab"].items() if v < VOCABULARY - 1}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"][: VOCABULARY - 1 - 256]]
    tokens = models.BPE(vocabulary, [tuple(m) for m in merges]).tokenize

    def run(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        names = (b" " + b"\n ".join(words)).decode("latin-1").translate(_NAMES).split("\n") if words else []
        got = [[t.id for t in tokens(x)] for x in names]
        return np.array([x for ids in got for x in ids], "<u2"), np.array(list(map(len, got)), np.int64)

    return run


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class WordIds(dict):
    """word -> its ids' bytes, with a blank before it; keeps the first CACHE words that it met."""

    def __init__(self, source: str):
        super().__init__()
        self.coder, self.table = coder(source), None

    def hot(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids of the words that every task knows, each one's number of ids, where they start); the last two have one place more."""
        if self.table is None:
            body, sizes = self.coder(words.to_pylist())
            sizes = np.append(sizes, 0)
            self.table = body, sizes, np.cumsum(sizes) - sizes
        return self.table

    def of(self, words: list[bytes]) -> list[bytes]:
        """Of words that differ."""
        out = list(map(self.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        ids, sizes = self.coder([words[k] for k in new])
        body, ends = ids.tobytes(), (2 * np.cumsum(sizes)).tolist()
        for k, at, to in zip(new, [0, *ends], ends):
            out[k] = body[at:to]
            if len(self) < CACHE:
                self[words[k]] = out[k]
        return out


_IDS: dict[str, WordIds] = cache()


def word_ids(source: str) -> WordIds:
    if source not in _IDS:
        _IDS.clear()
        _IDS[source] = WordIds(source)
    return _IDS[source]


def encode(texts: list[list[bytes]], source: str) -> list[np.ndarray]:
    """The subword ids of texts that are given by their words."""
    words = list(dict.fromkeys(x for w in texts for x in w))
    get = dict(zip(words, word_ids(source).of(words))).__getitem__
    return [np.frombuffer(b"".join(map(get, w)), "<u2") for w in texts]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, how many each text has); as words_of, in Arrow."""
    texts = texts.take(pa.array(np.arange(len(texts)), pa.int64()))  # fill_null gives wrong texts for a slice without nulls
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, ends = parts.flatten().cast(pa.large_binary()), parts.offsets.to_numpy()
    there = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends leave empty ones
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there), np.diff(before[ends - ends[0]])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over training documents; the end is the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = ends = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, ends
            count = pa.chunked_array(held, pa.large_binary()).value_counts()
            cols = [(count.field(0).cast(pa.binary()), [None]), (count.field(1), [ends])]
            out = pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array(y * bool(ends), x.type)]) for x, y in cols], ["word", "c"])
            held.clear()
            size = ends = 0
            return out

        for b in slices(batches):
            own = b.column("text").filter(pa.array([not is_held_out(d) for d in b.column("doc_id").to_pylist()], pa.bool_()))
            words, _ = split(own)
            held.append(words)
            size += words.nbytes
            ends += len(own)
            if size > COUNTED_BYTES:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(words: DataFrame, source: str) -> np.ndarray:
    """How often each subword id, and the end, occurs in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        code = coder(source)
        for b in slices(batches, 4096):
            w, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            there = np.array([y is not None for y in w], bool)
            ids, sizes = code([y for y in w if y is not None])
            np.add.at(total, ids, np.repeat(c[there], sizes))
            total[VOCABULARY - 1] += c[~there].sum()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def ids_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in b.column("ids").to_pylist()]


def trained(texts: DataFrame, start: attention.Model, source: str, expected: int, passes: int = 1, rate: float = RATE) -> DataFrame:
    """texts (ids, or text that is to be encoded) -> (weight: ids seen, body: the pickled weights and how often each id was met), a row for each partition with texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        own = attention.Trainer(start, VOCABULARY - 1, expected * passes, rate)
        met, n = np.zeros(VOCABULARY, np.int64), 0

        def feed() -> None:
            nonlocal n
            for _ in range(passes):
                own.feed(held)
            met[:] += np.bincount(np.concatenate(held), minlength=VOCABULARY)
            met[VOCABULARY - 1] += len(held)
            held.clear()
            n = 0

        for b in slices(batches):
            new = ids_of(b) if "ids" in b.schema.names else encode([words_of(t) for t in texts_of(b)], source)
            held += new
            n += sum(map(len, new)) + len(new)
            if n >= CHUNK:
                feed()
        if held:
            feed()
        if own.t:
            body = pickle.dumps((own.model["flat"], own.model["emb"], met))
            yield pa.RecordBatch.from_arrays([pa.array([int(met.sum())], pa.int64()), pa.array([body], pa.binary())], ["weight", "body"])

    return texts.mapInArrow(run, "weight long, body binary")


def _average(parts: DataFrame) -> DataFrame:
    """Weighted means of the rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, flat, emb, met = 0, None, None, None
        for b in slices(batches, 1):
            n, (f, e, m) = b.column("weight")[0].as_py(), pickle.loads(b.column("body")[0].as_py())
            total += n
            if flat is None:
                flat, emb, met = f, e, m
                continue
            flat += (f - flat) * np.float32(n / total)
            met = met + m
            emb += (e - emb) * (m / np.maximum(met, 1)).astype(np.float32)[:, None]
        if flat is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([pickle.dumps((flat, emb, met))], pa.binary())], ["weight", "body"])

    return parts.mapInArrow(run, "weight long, body binary")


def in_round(docs: DataFrame, k: int) -> DataFrame:
    """The training documents of round k; a row is in one round."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ROUNDS[-1]))
    return training(docs).where((part >= (ROUNDS[k - 1] if k else 0)) & (part < ROUNDS[k]))


def training(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return docs.where(~held)


def fit(scratch: Scratch, docs: DataFrame, counts: np.ndarray, source: str) -> attention.Model:
    model, total = attention.init(VOCABULARY, DIM, counts), int(counts.sum())
    passes = max(1, min(PASSES, -(-LEAST_IDS // max(total, 1))))
    for k, end in enumerate(ROUNDS):
        share = total * (end - (ROUNDS[k - 1] if k else 0)) // ROUNDS[-1]
        parts = max(1, min(MOST_PARTS, -(-share // IDS_A_PART)))
        dealt = in_round(docs, k).select("ids").repartition(parts)  # in turn, by no key: as many sets of weights as parts, and no more
        held = [scratch.table(trained(dealt, model, source, share // parts, passes, RATE / (1 + k)))]
        while parts > 8:
            parts = -(-parts // 8)
            held.append(scratch.table(_average(held[-1].repartition(parts))))
            scratch.drop(held.pop(0))
        got = _average(held[0].coalesce(1)).collect()  # one set of weights
        scratch.drop(held[0])
        if got:
            flat, emb, _ = pickle.loads(got[0]["body"])
            model = {**model, "flat": flat, "emb": emb}
    return model


def scores(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    words = scratch.table(word_counts(docs))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    levels = sorted((r[0], r[1]) for r in words.groupBy(F.floor(F.log2("c")).alias("level")).count().collect())  # 64 at most
    low, held = 0, 0
    for level, n in reversed(levels):
        if held + n > HOT_WORDS:
            low = 1 << (level + 1)
            break
        held += n
    hot = {None if r[0] is None else bytes(r[0]): r[1] for r in words.where(F.col("c") >= low).collect()}  # HOT_WORDS at most
    ends = words.where("word is null").first()
    hot[None] = ends["c"] if ends else 0
    source = learnt({w: c for w, c in hot.items() if w is not None}, path)
    end_known, end_log = int(hot[None] > 0), math.log10(hot.pop(None) + 1)
    shared = docs.sparkSession.sparkContext.broadcast((list(hot), [math.log10(c + 1) for c in hot.values()], source))
    del hot
    divisor = math.log10(total + distinct + 1)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, source = shared.value
        known, logs, own = pa.array(known, pa.large_binary()), np.array([*logs, -1.0]), word_ids(source)
        table, sizes_of, starts_of = own.hot(known)
        for b in slices(batches, 512):
            words, sizes = split(b.column("text"))
            found = words.dictionary_encode()
            each, which, doc = found.dictionary, found.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)  # each: words that differ
            place = pc.fill_null(pc.index_in(each, known), len(known)).to_numpy()
            new = np.flatnonzero(place == len(known))
            parts = own.of(each.take(pa.array(new)).to_pylist())
            body, long, start = np.concatenate([table, np.frombuffer(b"".join(parts), "<u2")]), sizes_of[place], starts_of[place]
            long[new] = np.array(list(map(len, parts)), np.int64) // 2
            start[new] = len(table) + np.cumsum(long[new]) - long[new]
            log, n, start = logs[place][which], long[which], start[which]
            ends = np.cumsum(n)
            ids = body[np.repeat(start - ends + n, n) + np.arange(n.sum())].tobytes()
            edges = (2 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]).tolist()
            seen = log >= 0
            key, k = np.unique(doc[~seen] * len(each) + which[~seen], return_counts=True)
            texts, rare = np.divmod(key, max(1, len(each)))
            pairs = pa.StructArray.from_arrays([each.take(pa.array(rare)).cast(pa.binary()), pa.array(k, pa.int64())], ["w", "k"])
            cols = [
                pa.array(map(is_held_out, b.column("doc_id").to_pylist()), pa.bool_()), pa.array(sizes + 1, pa.int64()), pa.array(np.bincount(doc[seen], minlength=len(sizes)) + end_known, pa.int64()),
                pa.array(np.bincount(doc[seen], log[seen], len(sizes)) + end_log, pa.float64()), pa.array([ids[at:to] for at, to in zip(edges, edges[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(len(sizes) + 1)), pa.int32()), pairs),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "held_out", "n_tokens", "known", "base", "ids", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, ids binary, rare array<struct<w:binary,k:long>>"
    rows = scratch.table(docs.mapInArrow(encoded, schema).withColumn("row", F.monotonically_increasing_id()))
    model = docs.sparkSession.sparkContext.broadcast(fit(scratch, rows, id_counts(words, source), source))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            score = attention.score(model.value, ids_of(b), VOCABULARY - 1) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(score, pa.float64())], [*kept, "score"])

    kept = ["doc_id", "held_out", "n_tokens", "known", "base", "row"]
    scores_of = rows.select(*kept, "ids").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, known long, base double, row long, score double")
    tail = rows.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.k")
    tail = tail.join(words.where(F.col("c") < low), F.col("w") == F.col("word"))
    tail = tail.groupBy(F.col("row").alias("r")).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("b"))
    out = scratch.table(scores_of).join(tail, F.col("row") == F.col("r"), "left")
    base = F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.lit(divisor)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return scores(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
