"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its words (between blanks, as written), the character n-grams of each word in its marks ``<`` and ``>``, and a mark for each word
that repeats the word before, each hashed into one of BUCKETS rows of an embedding matrix. The rows of all features are averaged, a feature counting as often as it occurs, and a linear layer with softmax gives the
probability of label 1. Embeddings and layer are learned together by stochastic gradient descent in numpy, one document at a time, with a falling rate.

Learning reads a bounded sample: the SAMPLE labelled documents with the smallest hash of doc_id (all, if there are fewer), and of these as many as hold
SAMPLE_CELLS distinct features. Features are made in tasks from whole texts; the driver receives the sample's sparse counts only. As the
output is linear in the average, embeddings and layer fold into one weight per bucket, which is broadcast (BUCKETS numbers); scoring is one gather and
one sum per text.

Rows: a null or empty text, or one of blanks, has no features, and its score is that of the bias alone. A text of any length counts whole. Held-out documents, and
rows without doc_id or label, are not learned from; a document that stands in several rows is learned once per label, with its smallest text. Without labels, or with labels of
one kind only, every score is the smoothed share of label 1 (0.5 without any). Equal texts have equal scores; repeated rows give repeated results; other columns do not
matter and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.langid import held_out
from proofline.llm.shingles import scrambled

BUCKETS = 1 << 16
#: Characters of the n-grams.
GRAMS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.2
#: The bounds of what is learned from: documents, and distinct features of all of them.
SAMPLE = 4_000
SAMPLE_CELLS = 12_000_000
THRESHOLD = 0.3
#: Code points worked on at once.
CHUNK_CHARS = 1 << 20
#: The feature of a word that stands twice in a row, and how often it counts (about the n-grams of a word).
REPEAT = np.uint64(0xD1B54A32D192ED03)
REPEAT_TIMES = 8
#: Features without effect that every text has besides its own, so that a few words alone decide little.
PADDING = 32
_OPEN, _CLOSE = 0x110000, 0x110001


def _blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def _marked(points: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a mark before and one after each, nothing between, and the word each place belongs to."""
    before = np.concatenate(([True], blank[:-1]))
    first = ~blank & before
    last = ~blank & np.concatenate((blank[1:], [True]))
    inner = np.flatnonzero(~blank)
    # Every word is two places longer than written.
    word = np.cumsum(first)[inner] - 1
    place = np.arange(len(inner)) + 2 * word + 1
    out = np.empty(len(inner) + 2 * int(first.sum()), dtype=np.uint64)
    owner = np.empty(len(out), dtype=np.int64)
    out[place], owner[place] = points[inner], word
    begin, end = place[first[inner]] - 1, place[last[inner]] + 1
    out[begin], out[end] = _OPEN, _CLOSE
    owner[begin] = owner[end] = np.arange(len(begin))
    return out, owner


def features(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams and words of a sequence of code points with the place of the word each is from, and the words alone with theirs."""
    blank = _blank(points)
    marked, owner = _marked(points, blank)
    if not len(marked):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none.view(np.uint64), none
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    found, where = [], []
    key = marked + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        key = key[:len(marked) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + marked[n - 1:] + np.uint64(1)
        if n in GRAMS:
            inside = owner[:len(key)] == owner[n - 1:]
            found.append(scrambled(key[inside] + np.uint64(n)))
            where.append(owner[:len(key)][inside])
    # A whole word, marks included, by the sum of its scrambled (place, character) numbers.
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    inner = np.arange(len(marked)) - begin[owner]
    words = scrambled(np.add.reduceat(scrambled(marked * np.uint64(0x2545F4914F6CDD1D) + inner.astype(np.uint64)), begin))
    found.append(words)
    where.append(np.arange(len(begin)))
    return np.concatenate(found), starts[np.concatenate(where)], words, starts


def _cut(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK_CHARS that end between words; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + CHUNK_CHARS
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def _parts(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of texts in parts of bounded size, with the texts' indexes."""
    part, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _cut(text):
            part.append(piece)
            owners.append(i)
            size += len(piece) + 1
            if size >= CHUNK_CHARS:
                yield part, np.array(owners)
                part, owners, size = [], [], 0
    if part:
        yield part, np.array(owners)


def text_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts) of all features, part by part."""
    last_word, last_text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part, index in _parts(texts):
        points = np.frombuffer(" ".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in part])))
        hashes, places, words, starts = features(points)
        owner_of = lambda x: index[np.searchsorted(bounds, x, side="right") - 1]
        # The pair of a word with itself is one feature, whatever the word.
        words, word_texts = np.concatenate((last_word, words)), np.concatenate((last_text, owner_of(starts)))
        again = word_texts[1:][(words[1:] == words[:-1]) & (word_texts[1:] == word_texts[:-1])]
        last_word, last_text = words[-1:], word_texts[-1:]
        hashes = np.concatenate((hashes, np.full(len(again) * REPEAT_TIMES, REPEAT)))
        yield (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), np.concatenate((owner_of(places), np.repeat(again, REPEAT_TIMES)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (order, doc_id, label, buckets, counts)."""
    for batch in batches:
        for doc_id, label, order, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            sums = np.zeros(BUCKETS, dtype=np.int64)
            for buckets, _ in text_features([text]):
                sums += np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(sums)
            yield pa.record_batch([
                pa.array([order], pa.int64()), pa.array([doc_id], pa.string()), pa.array([label], pa.int32()),
                pa.array([at], pa.list_(pa.int32())), pa.array([sums[at]], pa.list_(pa.int64())),
            ], names=["order", "id", "label", "buckets", "counts"])


@dataclass(frozen=True)
class Model:
    """One weight per bucket and a bias: the folded embeddings and layer."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> list[float]:
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owners in text_features(texts):
            sums += np.bincount(owners, weights=self.weights[buckets], minlength=len(texts))
            sizes += np.bincount(owners, minlength=len(texts))
        return (1.0 / (1.0 + np.exp(-np.clip(sums / (sizes + PADDING) + self.bias, -60, 60)))).tolist()


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """Learn from (label, buckets, shares) by stochastic gradient descent on the log loss."""
    rng = np.random.default_rng(seed)
    labels = np.array([s[0] for s in sample], dtype=np.int64)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS), float(np.log((ones + 0.5) / (len(labels) - ones + 0.5))) if len(labels) else 0.0)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, step = EPOCHS * len(sample), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            rate = RATE * (1 - step / steps)
            step += 1
            label, buckets, shares = sample[i]
            rows = vectors[buckets]
            hidden = shares @ rows
            raw = layer @ hidden + bias
            odds = np.exp(raw - raw.max())
            error = odds / odds.sum()
            error[label] -= 1.0
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            bias -= rate * error
            # Shares are scaled to a sum of one; the square root of the count of rows keeps steps alike for short and long texts.
            vectors[buckets] = rows - rate * np.outer(shares * np.sqrt(len(shares)), back)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the documents with a label 0 or 1 that are not held out."""
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    marks = marks.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    known = docs.select(F.col(doc_id).alias("_doc")).where(F.col("_doc").isNotNull())
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = marks.join(known, F.col("_id") == F.col("_doc"), "left_semi").withColumn("_order", order).orderBy("_order", "_id", "_label").limit(SAMPLE)
    # At most SAMPLE rows of three numbers.
    chosen = F.broadcast(chosen)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, F.col("_doc") == F.col("_id"))
    one = texts.groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text")).select(F.col("_id").cast("string").alias("_id"), "_label", "_order", "_text")
    counted = one.mapInArrow(_counts, "order long, id string, label int, buckets array<int>, counts array<long>")
    sample, cells = [], 0
    for row in counted.sort("order", "id", "label").toLocalIterator():
        buckets, counts = np.array(row.buckets, dtype=np.int64), np.array(row.counts, dtype=np.float64)
        cells += len(buckets)
        if cells > SAMPLE_CELLS:
            break
        sample.append((row.label, buckets, counts / (counts.sum() + PADDING)))
    return fit(sample)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from text to score, with the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([t if isinstance(t, str) else "" for t in texts]), dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from ``threshold`` on)."""
    score = scorer(docs.sparkSession, train(docs, labels, doc_id, text, label))
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text)).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
