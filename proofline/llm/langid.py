"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and runs of blanks become one. N-grams of one to three characters
(none of blanks only) are hashed into BUCKETS. Training counts n-grams per language over all labelled documents,
reducing each task to sums before anything moves; the matrix of log probabilities (languages x BUCKETS) is broadcast and
texts are scored in batches: one gather of rows per n-gram, one sum per text, plus the log prior.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. The score is the
posterior probability of the predicted language. The fit says how well the text looks like that language, whatever its length:
the mean log probability of its n-grams, less that of all n-grams learned from, in standard deviations of these. Ties go to the smaller name. Documents without lang or doc_id are not
learned from; other columns do not matter and may have any name. An empty table gives no rows, repeated rows repeated results. A very long text
is worked on in pieces, with the n-grams across their edges.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import packed
from proofline.llm.shingles import scrambled

BUCKETS = 1 << 15
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
#: Code points worked on at once; longer texts pass in pieces of this size with the same n-grams.
CHUNK_CHARS = 1 << 19
PREDICTION = "lang_pred string, score double, fit double, n_grams long"
#: The lowest fit of a text that is long, and what shorter ones may miss it by, over the square root of their n-grams.
LEAST_FIT, SHORT_SLACK = -2.5, 8.0


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a lower-cased text, and which of them are letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, _letters()[points]


def _hashed(points: np.ndarray, letter: np.ndarray, owner: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the n-grams of texts whose runs of blanks are one, but for those that end in the first ``lead`` points."""
    buckets, owners = [], []
    key = np.zeros(len(points), dtype=np.uint64)
    useful = np.zeros(len(points), dtype=bool)
    for n in range(ORDERS):
        size = len(points) - n
        if size <= 0:
            break
        key = key[:size] * np.uint64(0x110000 + 1) + points[n:] + np.uint64(1)
        useful = useful[:size] | letter[n:]
        inside = useful & (owner[:size] == owner[n:])
        inside[:max(0, lead - n)] = False
        buckets.append((scrambled(key[inside]) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[:size][inside])
    return np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text each belongs to, and whether a text has letters."""
    texts = [f" {t} ".lower() for t in texts]
    points, letter = _points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], dtype=np.int64))
    found = np.zeros(len(texts), dtype=bool)
    found[owner[letter]] = True
    # A blank stays only after a letter of the same text or at a text's start, so that runs of blanks are one.
    first = np.append(True, owner[1:] != owner[:-1])[:len(owner)]
    stay = letter | first | np.append(False, letter[:-1])[:len(letter)]
    buckets, owners = _hashed(np.where(letter, points, 32)[stay].astype(np.uint64), letter[stay], owner[stay])
    return buckets, owners, found


def _long_grams(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Buckets of the n-grams of a very long text, piece by piece: each piece is led by the end of the one before, so none is lost or met twice."""
    text = f" {text} ".lower()
    after_letter, points, letter = True, np.zeros(0, np.uint64), np.zeros(0, bool)
    for at in range(0, len(text), CHUNK_CHARS):
        new, is_letter = _points(text[at:at + CHUNK_CHARS])
        stay = is_letter | np.append(after_letter, is_letter[:-1])
        after_letter, lead = bool(is_letter[-1]), min(len(points), ORDERS - 1)
        points = np.concatenate([points[len(points) - lead:], np.where(is_letter, new, 32)[stay].astype(np.uint64)])
        letter = np.concatenate([letter[len(letter) - lead:], is_letter[stay]])
        yield _hashed(points, letter, np.zeros(len(points), np.int64), lead)[0], bool(is_letter.any())


def _in_parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of texts, the index of the text each belongs to, and indexes of texts with letters, in parts of bounded size."""
    part: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > CHUNK_CHARS:
            for buckets, found in _long_grams(text):
                yield buckets, np.full(len(buckets), i), np.array([i] if found else [], dtype=np.int64)
            continue
        part.append(i)
        size += len(text) + 2
        if size >= CHUNK_CHARS:
            yield _of_part(texts, part)
            part, size = [], 0
    if part:
        yield _of_part(texts, part)


def _of_part(texts: list[str], part: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets, owners, found = _grams([texts[i] for i in part])
    index = np.array(part)
    return buckets, index[owners], index[found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to sums per task: (lang, bucket, n); bucket -1 counts documents."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in langs:
            sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))[-1] += 1
        for buckets, owners, _ in _in_parts(texts):
            index = np.flatnonzero(np.bincount(owners, minlength=len(texts)))
            names = sorted({langs[i] for i in index})
            code = np.zeros(len(texts), dtype=np.int64)
            code[index] = [names.index(langs[i]) for i in index]
            counts = np.bincount(code[owners] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, counts):
                sums[name][:-1] += row
    for name, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([
            pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(total[at], pa.int64()),
        ], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    """Languages in order, log P(bucket | language) as (languages, BUCKETS), log priors, and per language the mean and standard
    deviation of the log probability of an n-gram learned from."""

    languages: tuple[str, ...]
    logs: np.ndarray
    prior: np.ndarray
    usual: np.ndarray
    spread: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, posterior, fit and number of n-grams of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)
        sums, found = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), dtype=bool)
        grams = np.zeros(len(texts), dtype=np.int64)
        for buckets, owners, lettered in _in_parts(texts):
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owners, weights=self.logs[k][buckets], minlength=len(texts))
            found[lettered] = True
            grams += np.bincount(owners, minlength=len(texts))
        best = sums.argmax(axis=1)
        mean = (sums - self.prior)[np.arange(len(texts)), best] / np.maximum(grams, 1)
        fit = (mean - self.usual[best]) / np.maximum(self.spread[best], 1e-9)
        share = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[b] if f else UNKNOWN for b, f in zip(best, found)]
        return names, np.where(found, share, 0.0).tolist(), np.where(found, fit, 0.0).tolist(), grams.tolist()


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its doc_id, kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the documents that have text, lang and doc_id and are not held out. Only sums reach the driver."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    parts = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, bucket int, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(table["lang"]), key=lambda x: x.encode()))
    counts, docs_of = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    code = table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    grams = bucket >= 0
    counts[code[grams], bucket[grams]] = n[grams]
    docs_of[code[~grams]] = n[~grams]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    weights = counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))
    usual = (weights * logs).sum(axis=1)
    spread = np.sqrt((weights * (logs - usual[:, None]) ** 2).sum(axis=1))
    return Model(languages, logs, np.log(docs_of / max(1.0, docs_of.sum())), usual, spread)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from text to (lang_pred, score, fit, n_grams), with the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(texts):
        import pandas as pd

        names, scores, fits, grams = shared.value.judge([t if isinstance(t, str) else "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores, "fit": fits, "n_grams": grams})

    return predict


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score."""
    predict = predictor(docs.sparkSession, train(docs, doc_id, text, lang))
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict(F.col(text)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language could be told: not ``und``, with a posterior of at least ``least``, and with n-grams
    that look like that language. A long text of noise, or in a language never learned, has a high posterior for some
    language but fits none; short ones get the benefit of the doubt."""
    predict = predictor(docs.sparkSession, train(docs, doc_id, text, lang))
    marked = docs.select(packed(docs).alias("_row"), predict(F.col(text)).alias("_p"))
    fits = F.col("_p.fit") >= LEAST_FIT - SHORT_SLACK / F.sqrt(F.greatest(F.col("_p.n_grams"), F.lit(1)))
    return marked.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least) & fits).select("_row.*")
