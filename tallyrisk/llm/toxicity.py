"""Toxicity by two class-conditional Kneser-Ney word models.

A toxic and an ordinary bigram model give each word of a text a log-likelihood under either
class. Bigrams back off to how many different words a word follows within the class, and that to
counts shared by both classes, which are taken over all documents. What the discount frees, and a
prior of some sightings, goes to the lower order, so a rare expression says little and a word neither class knows
says nothing. Words and pairs seen once are in the models. The score rests on the difference of the two
log-likelihoods per word of the text: its mean, its mean above `mild`, and the share of words over
`strong`, so that a few telling words are not lost in a long text. A logistic function of the three
is fitted on labelled rows that the models did not see.

The models are fitted on a sample of the labelled rows of about `sample_bytes` of text per class
(all rows if there is less), which bounds their size and lets them be broadcast: words that only
other labelled rows hold are unknown to the models. Everything else runs over all rows.

Labelled rows whose crc32(doc_id) mod 5 is 0 are never learned from; remainders 1 to 3 feed the
models, 4 the logistic function.

Defined results: null and empty texts score as texts without evidence; a label that is null or
names no document is ignored, several labels of one document count as their largest; a null
doc_id is not learned from; exact copies count once in the models; without labels of both classes
every score rests on the plain log-likelihood difference; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import store

FOLDS = 5
CLASSES = ("ordinary", "toxic")
FEATURES = ("whole", "above", "strong")
TASK_WORDS = 500_000  # counted in a task before they are handed on

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    sample_bytes: int = 12_000_000
    sample_rows: int = 200_000
    discount: float = 0.75
    prior: float = 1.0  # sightings that the lower order is worth
    mild: float = 1.5  # differences in nats
    strong: float = 3.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    """Two bigram models over one list of words; index 0 is ordinary, 1 is toxic. Likelihoods are
    relative to counts that both classes share, which cancel out of the difference."""
    words: list[bytes]
    single: np.ndarray  # the difference each word makes, the last entry is any other word
    pairs: np.ndarray  # sorted codes first * (words + 1) + second
    seen: np.ndarray  # the difference each pair makes
    places: dict[bytes, int] = field(default_factory=dict)

    def differences(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood under the toxic model minus under the ordinary one, word by word."""
        if not self.places:
            self.places.update((w, i) for i, w in enumerate(self.words))
        other = len(self.words)
        ids = np.fromiter((self.places.get(w, other) for w in words), np.int64, len(words))
        before = np.concatenate(([other], ids[:-1]))
        found = self.single[ids]
        known = np.flatnonzero((ids < other) & (before < other))
        if len(known) and len(self.pairs):
            codes = before[known] * (other + 1) + ids[known]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            hit = self.pairs[at] == codes
            found[known[hit]] = self.seen[at[hit]]
        return found


def evidence(model: Model, text: str | None, settings: Settings) -> tuple[float, float, float]:
    """Per word of the text: the difference, its part above `mild`, and the share of words over `strong`."""
    words = words_of(text)
    if not words:
        return 0.0, 0.0, 0.0
    d = model.differences(words)
    above = np.clip(d - settings.mild, 0, settings.strong)
    return float(d.mean()), float(above.mean()), float((d > settings.strong).mean())


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """toxic, text of the rows the models are fitted on."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = remainder(F.col("doc_id")).isin(1, 2, 3)
    sizes = store(docs.where(fit).select("doc_id", F.octet_length("text").alias("bytes")).join(known, "doc_id"), "labelled")
    total = {r["toxic"]: (r["b"] or 0, r["n"]) for r in sizes.groupBy("toxic").agg(
        F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for label, (size, rows) in total.items():  # two labels
        share = min(1.0, settings.sample_bytes / max(size, 1), settings.sample_rows / max(rows, 1))
        keep = keep | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    chosen = store(sizes.where(keep).select("doc_id", "toxic").distinct(), "sampled")
    if chosen.count() <= 2 * settings.sample_rows:  # 16 bytes a row, so a few MB
        chosen = F.broadcast(chosen)
    return docs.where(fit).select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text").distinct()


def _counts(sample: DataFrame) -> DataFrame:
    """first, second, ordinary, toxic: in how many sampled texts of each class a pair occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, first, second = [], [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for a, b in set(zip([b"", *words], words)):
                    label.append(int(toxic > 0))
                    first.append(a)
                    second.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(first, pa.binary()), pa.array(second, pa.binary())],
                names=["toxic", "first", "second"])

    pairs = sample.mapInArrow(run, "toxic int, first binary, second binary")
    return pairs.groupBy("first", "second").agg(*[F.count_if(F.col("toxic") == c).alias(name) for c, name in enumerate(CLASSES)])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in all documents, whether a model knows it or not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in words_of(text):
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > TASK_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The two models. The driver holds words and pairs of the bounded sample; the counts of all
    words of the corpus stay a table."""
    counts = store(_counts(store(_sample(docs, labels, settings), "sample")), "pair_counts")
    corpus = store(corpus_counts(docs), "corpus_counts")
    size = corpus.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).head()
    sides = [F.col(c) for c in CLASSES]
    after = counts.groupBy(F.col("second").alias("word")).agg(*[F.count_if(n > 0).alias(f"after{c}") for c, n in enumerate(sides)])
    before = counts.groupBy(F.col("first").alias("word")).agg(*[F.sum(n).alias(f"whole{c}") for c, n in enumerate(sides)])
    rows = after.join(before, "word", "left").join(corpus, "word", "left").toArrow().sort_by("word")
    both = lambda name: np.array([rows[f"{name}{c}"].fill_null(0).to_numpy() for c in (0, 1)], dtype=float)
    other, follows, whole = len(rows), both("after"), both("whole")
    shared = (rows["n"].fill_null(0).to_numpy() + 1.0) / ((size["n"] or 0) + size["types"] + 1)
    single = np.ones((2, other + 1))  # a word neither class knows is equally likely in both
    single[:, :other] = _times(follows, follows.sum(axis=1, keepdims=True) * shared, 1.0, settings)
    words = rows["word"].combine_chunks()
    del rows
    found = counts.where(F.octet_length("first") > 0).toArrow()
    codes, pair, at = np.empty(len(found), np.int64), np.empty(len(found), np.float32), 0
    for batch in found.to_batches(max_chunksize=100_000):  # the working arrays stay small
        first, second = (pc.index_in(batch[x], words).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("first", "second"))
        here = slice(at, at := at + len(batch))
        codes[here] = first * (other + 1) + second
        docs_of = np.array([batch[c].to_numpy(zero_copy_only=False) for c in CLASSES], dtype=float)
        share = docs_of.sum(axis=0) / np.maximum(whole[:, first].sum(axis=0), 1)
        pair[here] = _difference(_times(docs_of, whole[:, first] * share, single[:, second], settings))
    del found
    order = np.argsort(codes)
    return Model(words.to_pylist(), _difference(single), codes[order], pair[order])


def _difference(chance: np.ndarray) -> np.ndarray:
    return np.log(chance[1]) - np.log(chance[0])


def _times(seen: np.ndarray, expected: np.ndarray, lower: np.ndarray | float, settings: Settings) -> np.ndarray:
    """How many times likelier than expected in each class: discounted counts, the discount and
    `prior` sightings going to the lower order."""
    freed = settings.prior + settings.discount * (seen > 0)
    return (np.maximum(seen - settings.discount, 0) + freed * lower) / (expected + settings.prior)


def _weights(rows: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of the logistic function."""
    if rows.select("toxic").distinct().count() < 2:
        return [1.0, 0.0, 0.0], -1.0
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = LogisticRegression(labelCol="toxic", regParam=1e-4, maxIter=50).fit(made)
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted and the evidence."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(model.value, t, settings) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = store(rows, "evidence")
    known = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("toxic"))
    weights, intercept = _weights(rows.where(remainder(F.col("doc_id")) == FOLDS - 1).join(known, "doc_id"))
    margin = F.lit(intercept)
    for f, w in zip(FEATURES, weights):
        margin = margin + F.col(f) * F.lit(w)
    chance = 1 / (1 + F.exp(-margin))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                       chance.alias("score"), (chance >= 0.5).cast("int").alias("predicted"), *FEATURES)
