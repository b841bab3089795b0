"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words, pairs of neighbouring words
and character n-grams, all hashed to a fixed number of buckets; a softmax over two
classes reads the average.  The model is trained with numpy stochastic gradient descent
on a bounded sample of labelled documents.  The average is linear, so what scoring needs
of the model is one number per bucket: that table, of fixed size, is all that is sent to
the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import SLICE, Texts, mixed, release, slices

BUCKETS, DIM, GRAMS, EPOCHS, RATE, SEED = 1 << 17, 10, (3, 4), 5, 0.4, 11
#: The bucket of any repeated word.
SAME = 1
#: The bounded sample: so many labelled rows.
SAMPLE = 5000
#: Bytes of text whose features are taken at once: arrays of some 100 bytes for each byte stand beside them.
MOST = SLICE // 8


def features(texts: Texts, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of every feature of every text, as arrays, and where in each the texts start."""
    up_to = np.uint64(buckets - 1)
    prefix = texts.prefix()
    words = texts.span(prefix, texts.starts, texts.ends)
    ids, at = [(words & up_to).astype(np.int32)], [texts.first]
    last = np.zeros(len(words) + 1, bool)
    last[texts.first] = True  # no pair across texts
    pairs = np.flatnonzero(~last[1:-1]) if len(words) > 1 else np.zeros(0, np.int64)
    # a word that stands twice in a row is one feature, whatever the word
    both = mixed(words[pairs] * np.uint64(0x9E3779B97F4A7C15) + words[pairs + 1]) if len(pairs) else np.zeros(0, np.uint64)
    both[words[pairs] == words[pairs + 1]] = np.uint64(SAME)
    ids.append((both & up_to).astype(np.int32))
    at.append(np.searchsorted(pairs, texts.first))
    chars = np.flatnonzero((texts.data & 0xC0) != 0x80)
    ends = np.append(chars, len(texts.data))
    text_at = np.searchsorted(chars, texts.offsets)
    for n in grams:
        # all runs of n characters; those that cross into the next text fall out below
        fits = np.ones(max(0, len(chars) - n + 1), bool)
        for cut in text_at[1:-1]:
            fits[max(0, cut - n + 1) : cut] = False
        begin = np.flatnonzero(fits)
        found = texts.span(prefix, chars[begin], ends[begin + n])
        ids.append((mixed(found + np.uint64(n)) & up_to).astype(np.int32))
        at.append(np.searchsorted(begin, text_at))
    return ids, at


def shares(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the share of each: every kind of feature (words,
    pairs, n-grams of each length) is averaged by itself and weighs the same."""
    weights = np.concatenate([np.full(len(x), 1 / (len(kinds) * max(1, len(x)))) for x in kinds])
    unique, where = np.unique(np.concatenate(kinds), return_inverse=True)
    return unique, np.bincount(where, weights, len(unique)).astype(np.float32)


class Rows:
    """What shares() gives for each text, exactly, in half the memory: buckets are in order,
    so 16 bits of each do with the places where the rest changes; shares are few distinct numbers."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []

    def __len__(self) -> int:
        return len(self.held)

    def add(self, ids: np.ndarray, weights: np.ndarray) -> None:
        values, places = np.unique(weights, return_inverse=True)
        cuts = np.searchsorted(ids, np.arange(1 << 16, BUCKETS, 1 << 16))
        self.held.append((ids.astype(np.uint16), cuts, values, places.astype(np.min_scalar_type(len(values)))))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        low, cuts, values, places = self.held[i]
        ids = low.astype(np.int32)
        for cut in cuts:
            ids[cut:] += 1 << 16
        return ids, values[places]


class Model:
    """Bucket vectors, output weights and bias."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, seed: int = SEED):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.vectors = draw.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out, self.bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)

    def train(self, rows: Rows, classes: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        """rows: buckets of a document and the share of each."""
        draw, steps, done = np.random.Generator(np.random.PCG64(seed)), epochs * len(rows), 0
        # start from the share of each class, which a text without features then gets
        share = (np.bincount(classes, minlength=2) + 1) / (len(classes) + 2)
        self.bias[:] = np.log(share)
        seen, out_seen = np.zeros(len(self.vectors), np.float32), np.zeros(self.out.shape, np.float32)
        for _ in range(epochs):
            for i in draw.permutation(len(rows)).tolist():
                (ids, weights), pace = rows[i], rate * (1 - done / steps)
                done += 1
                if not len(ids):
                    continue
                own = self.vectors[ids]
                hidden = weights @ own
                z = hidden @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[classes[i]] -= 1
                back = (self.out @ p).astype(np.float32)
                step = np.outer(hidden, p)
                out_seen += step * step
                self.out -= pace * step / np.sqrt(out_seen + 1e-8)
                # each vector's step shrinks with the steps that it has made
                own_step = weights[:, None] * back[None, :]
                seen[ids] += weights * weights * float(back @ back)
                self.vectors[ids] = own - pace * own_step / np.sqrt(seen[ids] + 1e-8)[:, None]

    def table(self) -> tuple[np.ndarray, float]:
        """Log odds that each bucket adds, and the bias."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def learned(batches: Iterator[pa.RecordBatch], epochs: int, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    """The table and the bias of a model trained on the texts and classes y of the batches."""
    rows, classes = Rows(), []
    for batch in slices(batches, most=MOST):
        ids, at = features(Texts(batch.column("text")))
        for i in range(batch.num_rows):
            rows.add(*shares([x[a[i] : a[i + 1]] for x, a in zip(ids, at)]))
        classes += batch.column("y").to_pylist()
        del batch, ids, at
    if classes:
        model = Model()
        model.train(rows, np.array(classes), epochs, rate, seed)
        weights, bias = model.table()
        del rows, model
        release()
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, train_on, label_col: str, sample: int = SAMPLE, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Train on at most `sample` labelled rows, those of lowest hash of the id.

    Labels other than 0 and 1, null ids and ids with contradicting labels are left out; of
    an id that stands more than once the first text in order is taken.  No labelled rows: even odds.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train_on(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y1")).where("y = y1").select("id", F.col("y").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    taken = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return learned(batches, epochs, rate, seed)

    # the sample is bounded, so one task holds it; a lost one is run again, with the same result
    found = taken.repartition(1).sortWithinPartitions("id").mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(found[0].weights, np.float32), found[0].bias) if found else Model().table()


def scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, keep: list[str], read: str) -> Iterator[pa.RecordBatch]:
    """The kept columns and the score of each row, from the text named read."""
    for batch in slices(batches, read, MOST):
        kinds, odds = list(zip(*features(Texts(batch.column(read))))), np.full(batch.num_rows, bias)
        for ids, at in kinds:
            sums = np.concatenate([[0], np.cumsum(weights[ids], dtype=np.float64)])
            odds += (sums[at[1:]] - sums[at[:-1]]) / (len(kinds) * np.maximum(np.diff(at), 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=[*keep, "score"])
        del batch


def scores(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns named in keep and score, the chance of label 1, of each row of docs."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select(*keep).schema

    # a kept text is sent once; null is scored as empty
    once = text_col in keep and shape[text_col].dataType == T.StringType()
    read = text_col if once else "scored text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, *table.value, keep, read)

    rows = docs.select(*keep, *([] if once else [F.col(text_col).cast("string").alias(read)]))
    return rows.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", score double")


def fold(id_column, folds: int = 5):
    """crc32 of the id as text, by remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted.

    Trains where fold() is not 0.  Null and empty texts have no features and get the share
    of label 1 in the sample; repeated rows get equal scores; other columns are ignored.
    """
    model = fit(docs, labels, lambda c: fold(c) != 0, "quality", id_col=id_col, text_col=text_col, **fitting)
    found = scores(docs.select(id_col, text_col), model, [id_col], text_col)
    return found.select(id_col, (fold(F.col(id_col)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
