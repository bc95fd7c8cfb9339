"""Toxicity by subword-bag embeddings (operator 9).

A word is the average of the vectors of its character 3- to 6-grams (ends marked,
hashed into a fixed number of buckets); a text is the average of its worst few distinct
words; a linear softmax turns that into two classes. Vectors and softmax are trained
jointly, in numpy, on a bounded sample of labelled documents. Misspellings and new
endings share most of their n-grams with words that were seen.

Because the worst words stand for the text, a few words in a long text still count, and
a word that clean texts have once in a while counts less than several of its kind.
Training begins with the average of all words and goes on with those that the model
finds worst in each document.

As all of it is averages of linear maps, a trained model is one number for each bucket;
scoring a text is a lookup for each n-gram, in a map over the input with no shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.wordstream import parts_of, slices

#: Sizes of n-grams, hash buckets, dimensions of vectors, and how many distinct words stand for a text.
GRAMS, BUCKET_BITS, DIMENSIONS, WORST = (3, 4, 5, 6), 17, 10, 8
#: The sample that is trained on: documents of each label, whole, however long.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
WARM_UP, EPOCHS, RATE = 12, 48, 0.4
#: Bytes of text that are scored at once.
STEP_BYTES = 1 << 20

_FACTORS = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 31, max(GRAMS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORD = re.compile(r"[^\W_]+")


@functools.lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


class _Subwords:
    """Words of a buffer of code points, and the bucket of every n-gram in it."""

    def __init__(self, texts: list[str]):
        joined = "\n" + "".join(f"{t}\n" for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _word_characters()[code]
        step = np.diff(inside.astype(np.int8))
        self.start, self.end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        begins = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.start, begins)
        self.code = np.where(inside, code, np.uint32(1))

    def buckets(self, n: int, hashed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams at each place; ``hashed``: from n - 1, so that sizes build on each other."""
        total = np.zeros(len(self.code), np.uint32) if hashed is None else hashed
        for j in range(0 if hashed is None else n - 1, min(n, len(total))):
            total[: len(total) - j] += self.code[j:] * _FACTORS[j]
        spread = (total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x9E3779B1 % (1 << 32))
        return (spread * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS), total

    def grams(self) -> np.ndarray:
        """How many n-grams each word has, its end marks included."""
        size = self.end - self.start
        return sum(np.maximum(size + 3 - n, 0) for n in GRAMS)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """For each word, the mean weight of its n-grams."""
        total, hashed = np.zeros(len(self.start)), None
        for n in GRAMS:
            bucket, hashed = self.buckets(n, hashed)
            sums = np.concatenate([[0.0], np.cumsum(weight[bucket], dtype=np.float64)])
            last = np.maximum(self.end + 2 - n, self.start - 1)
            total += sums[last] - sums[self.start - 1]
        return total / np.maximum(self.grams(), 1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of word and bucket."""
        word, found, hashed = [], [], None
        for n in GRAMS:
            bucket, hashed = self.buckets(n, hashed)
            count = np.maximum(self.end - self.start + 3 - n, 0)
            which = np.repeat(np.arange(len(count), dtype=np.int32), count)
            place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - self.start + 1, count)
            word.append(which)
            found.append(bucket[place].astype(np.int32))
        return np.concatenate(word), np.concatenate(found)


def _worst_mean(words: np.ndarray, worst: int) -> float:
    """The mean of the greatest few distinct scores; equal words have equal scores."""
    if not len(words):
        return 0.0
    ordered = np.sort(words)
    return float(ordered[np.append(ordered[1:] != ordered[:-1], True)][-worst:].mean())


@dataclass
class Toxicity:
    """A trained model: a weight for each bucket, and a bias."""

    weight: np.ndarray
    bias: float
    worst: int = WORST

    def score(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1 for each text, the whole of it."""
        out = np.empty(len(texts))
        for lo, hi in slices(texts, STEP_BYTES):
            subwords = _Subwords([t.lower() for t in texts[lo:hi]])
            words, first = subwords.scores(self.weight), subwords.first
            worst = np.array([_worst_mean(words[a:b], self.worst) for a, b in zip(first, first[1:], strict=False)])
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(worst + self.bias, -40, 40)))
        return np.round(out, 9)


def _constant(toxic: np.ndarray, importance: np.ndarray) -> Toxicity:
    """Where no label or only one is known, nothing tells texts apart: one score for all, that rejects none."""
    share = float(np.average(toxic, weights=importance)) if len(toxic) else 0.0
    share = min(max(share, 1e-6), 0.49)
    return Toxicity(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))


def train(token: np.ndarray, size: np.ndarray, vocabulary: list[str], toxic: np.ndarray, importance: np.ndarray, seed: int = 3) -> Toxicity:
    """Fit vectors and softmax jointly.

    ``token``: the numbers, in ``vocabulary``, of the distinct words of all documents, one
    document after the other; ``size``: how many each has; ``importance``: its weight.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return _constant(toxic, importance)
    first = np.concatenate([[0], np.cumsum(size)])
    word, bucket = _Subwords([" ".join(vocabulary)]).features()
    n_words = len(vocabulary)
    per_word = np.bincount(word, minlength=n_words).astype(np.float64)

    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2))
    bias = np.zeros(2)
    importance = importance / importance.sum()
    seen = [np.full_like(p, 1e-8) for p in (vectors, softmax, bias)]
    balanced = np.where(toxic > 0, 0.5 / (toxic > 0).sum(), 0.5 / (toxic == 0).sum())
    for epoch in range(WARM_UP + EPOCHS):
        direction = softmax[:, 1] - softmax[:, 0]
        of_word = np.bincount(word, (vectors @ direction)[bucket], n_words) / per_word
        if epoch < WARM_UP:
            # while all words stand for a document the classes count the same, so that rare words come up
            place, length, share = np.arange(len(token)), size, balanced
        else:
            picks = []
            for a, b in zip(first, first[1:], strict=False):
                own = of_word[token[a:b]]
                picks.append(a + (np.argpartition(own, b - a - WORST)[b - a - WORST :] if b - a > WORST else np.arange(b - a)))
            place, length, share = np.concatenate(picks), np.minimum(size, WORST), importance
        who = np.repeat(np.arange(len(toxic)), length)
        mean = np.bincount(who, of_word[token[place]], len(toxic)) / np.maximum(length, 1)
        p = 1 / (1 + np.exp(-np.clip(mean + bias[1] - bias[0], -40, 40)))
        slope = share * (p - toxic)
        by_word = np.bincount(token[place], (slope / np.maximum(length, 1))[who], n_words) / per_word
        by_bucket = np.bincount(bucket, by_word[word], 1 << BUCKET_BITS)
        ahead = by_bucket @ vectors
        steps = (by_bucket[:, None] * direction, np.stack([-ahead, ahead], 1), np.array([-slope.sum(), slope.sum()]))
        for value, step, past in zip((vectors, softmax, bias), steps, seen, strict=True):
            past += step * step
            value -= RATE * step / np.sqrt(past)
    return Toxicity((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(set(_WORD.findall((t.as_py() or "").lower()))) for t in batch["text"]]
        columns = [batch["doc"], batch["label"], pa.array(words, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "label", "words"])


def train_on(
    docs: DataFrame,
    labels: DataFrame,
    held_out: int = 5,
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Toxicity:
    """Train on a sample of the labelled documents outside the held-out fold.

    The sample is the rows of each label with the least hashes of their ids, at most
    ``most_toxic`` and ``most_clean``, however long their texts; the driver gets their
    distinct words, made on the executors. Labels weigh as the roots of how many documents
    have them.

    Defined cases: rows without id or label, and labels other than 0 and 1, are not used;
    a document that any row calls toxic is toxic; of repeated documents the least text is
    used; a labelled id without a document adds nothing; without both labels every text
    scores the same, below 0.5 (0.49 if all known ones are toxic).
    """
    label = F.col(f"`{label_col}`").cast("int")
    usable = (
        labels.select(F.col(f"`{id_col}`").alias("doc"), label.alias("label"))
        .where(F.col("doc").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc"), held_out) != 0))
        .groupBy("doc")
        .agg(F.max("label").alias("label"))
    )
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = None
    for label, most in ((1, most_toxic), (0, most_clean)):
        rows = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc"), "doc").limit(most)
        picked = rows if picked is None else picked.unionByName(rows)
    # at most most_toxic + most_clean rows of 12 bytes
    sample = (
        docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(picked), "doc")
        .groupBy("doc", "label")
        .agg(F.min("text").alias("text"))
        .mapInArrow(_distinct_words, T.StructType([picked.schema["doc"], picked.schema["label"], T.StructField("words", T.ArrayType(T.StringType()))]))
        .toArrow()
        .sort_by("doc")
        .combine_chunks()
    )
    toxic = sample["label"].to_numpy().astype(np.float64)
    mine = {label: max(1, int((toxic == label).sum())) for label in (0, 1)}
    # half way (in logits) between the classes as they are and as many of each: a miss costs more than a false alarm
    importance = np.array([counts[int(x)] ** 0.5 / mine[int(x)] for x in toxic], np.float64)
    words = pa.concat_arrays([c.flatten() for c in sample["words"].chunks] or [pa.array([], pa.string())]).dictionary_encode()
    size = np.array([len(x) for x in sample["words"]], np.int64)
    return train(words.indices.to_numpy(), size, words.dictionary.to_pylist(), toxic, importance)


def with_scores(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The input row as struct ``row``, and its ``score``.

    Defined cases: a null text is an empty one, which has the score of the bias alone;
    any length is scored whole; repeated rows each get a score; an empty table works;
    other columns are carried in ``row``, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few megabytes of texts at a time are Python strings
            parts = [shared.value.score([t or "" for t in some.to_pylist()]) for some in parts_of(batch["text"], 4 * STEP_BYTES)]
            scores = np.concatenate([np.empty(0), *parts])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(scores, pa.float64())], names=["row", "score"])

    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return state.mapInArrow(score, T.StructType([state.schema["row"], T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    return with_scores(docs, train_on(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from ``labels`` outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        F.coalesce(fold(F.col("row.doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
