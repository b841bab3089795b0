"""Packing documents into sequences of a fixed length.

Every document is encoded where it lies and cut at multiples of the sequence length;
only lengths, places and checksums of the pieces are shuffled, never ids.  Full pieces
are sequences of their own.  The rest goes, in the order of a hash, to groups of at
most GROUP pieces, and each group is packed by first-fit decreasing over a tournament
tree of the bins' remaining room, apart from all other groups.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NOT_LATIN, UNSPACED, Bpe, Cache
from .slices import slices

#: Words that a worker caches, in each of two generations.
CACHED = 400_000
#: Pieces packed together at most; a group lies in one task.
GROUP = 8192
_encoders: dict = {}


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, word by word: the vocabulary drops
    white space, so each run between white space is encoded by itself, once."""

    def __init__(self, path: str, cached: int = CACHED):
        self.bpe, self.split = Bpe(path), regex.compile(UNSPACED)
        self.piece = self.bpe.piece_ids
        self.cache = Cache(self.word, cached)
        self.pre = Cache(lambda x: array("I", self.piece(x)).tobytes(), cached // 4)

    def word(self, word: str) -> bytes:
        if not word.isascii() and NOT_LATIN.search(word) or "<" in word and any(x in word for x in self.bpe.special):
            return array("I", self.bpe.library_ids(word)).tobytes()
        low = word.lower()
        if low.isalpha():
            return array("I", self.piece(low)).tobytes()
        if low[-1] in ".,;:!?" and (body := low[:-1]).isalpha():
            return (self.cache.get(body) or array("I", self.piece(body)).tobytes()) + self.pre[low[-1]]
        return b"".join(map(self.pre.__getitem__, self.split.findall(low)))

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return array("I", self.bpe.library_ids(text)).tobytes()
        return b"".join(map(self.cache.__getitem__, text.split()))


class Bins:
    """Tournament tree: each node holds the most room of any bin below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first(self, length: int) -> tuple[int, int]:
        """Take length from the leftmost bin that has room; its number and room before."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < length:
                at += 1
        room = tree[at]
        leaf, tree[at] = at - self.size, room - length
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return leaf, room


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length; ties in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Bins(len(lengths), room)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], left = tree.first(int(lengths[i]))
        offsets[i] = room - left
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int, room: int, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end_id, so an empty or null text is the one id
    end_id.  Repeated rows are packed as often as they stand there.  sequence_id holds
    the task in its high bits and the sequence within it in its low 40 bits; ids need not
    be without gaps.  Rows with a null id keep it.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(path)
        for batch in slices(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = (encoder(text) if text else b"") + last
                for at in range(0, len(ids), 4 * room):
                    piece = ids[at : at + 4 * room]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["id", "start", "length", "crc", "total"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, used = TaskContext.get().partitionId() << 40, 0
        for batch in regrouped(batches, group):
            bins, offsets = first_fit_decreasing(batch.column("length").to_numpy(), room)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base + used + bins), pa.array(offsets)], names=["id", "start", "length", "crc", "total", "sequence_id", "offset"])
            used += int(bins.max()) + 1

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(encode, f"id {kind}, start long, length long, crc long, total long")
    order = F.xxhash64("id", "start", "crc")
    dealt = pieces.withColumn("at", order).repartition("at").sortWithinPartitions("at", "id", "start").drop("at")
    packed = dealt.mapInArrow(place, f"id {kind}, start long, length long, crc long, total long, sequence_id long, offset long")
    return packed.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of rows rows, the last smaller."""
    kept, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(rows - n, batch.num_rows)
            kept.append(batch.slice(0, take))
            batch, n = batch.slice(take), n + take
            if n == rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
