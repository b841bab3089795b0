"""Removal of passages that an earlier document has, by level-wise doubling.

Levels are window lengths, each at most twice the one before, up to the asked length.
Windows of a level that only one document has are done with; the others are extended to
the next level's length, and so on until no candidate survives or the asked length is
reached.  A longer repeated passage is a union of repeated windows of the asked length, so
nothing longer could be removed in addition.

At the first level only the window of lowest hash inside each window of the asked length
is looked at (equal windows look at equal ones), which is a quarter of all positions at
the default length.  At each later level the window grows to the right from there, and to
the left where it would leave the window of the asked length.

Texts are shuffled once for each level after the first and once to cut; hashes of windows
only as far as the level before survives.  Minima are partial sums before any shuffle,
joins read written tables, so that Spark can split the rows of a frequent window, and
each table is dropped when it has been read.  Windows of the asked length are compared by
96 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch

from .slices import Texts, mixed, slices

STEP, OTHER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: The first level's windows have at most so many words.
SHORTEST = 7


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the shortest to the asked one, each at most twice the last."""
    found = [length]
    while found[0] > shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


def rolled(words: np.ndarray, length: int, step: int = STEP) -> np.ndarray:
    """Hash of the window of so many words that starts at each word, for as many as fit.

    Built by doubling: a window is two windows of half its length, and a word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(step, k, 1 << 64))
    total, have = words, 1
    for bit in bin(length)[3:]:
        total, have = total[: len(total) - have] * power(have) + total[have:], 2 * have
        if bit == "1":
            total, have = total[:-1] * power(1) + words[have:], have + 1
    return mixed(total)


def starts(first: np.ndarray, length: int) -> np.ndarray:
    """For each word whether a window of so many words of its text starts there."""
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(len(end)) + length <= end


def lowest_at(hashes: np.ndarray, span: int, n: int) -> np.ndarray:
    """Where the lowest of the `span` hashes from each of n places on is; the lowest bits,
    which hold the distance, decide between equal ones."""
    low_bits = np.uint64((1 << (span - 1).bit_length()) - 1)
    high = hashes & ~low_bits
    low = high[:n].copy()
    for i in range(1, span):
        np.minimum(low, high[i : i + n] | np.uint64(i), out=low)
    return np.arange(n) + (low & low_bits).astype(np.int64)


def member(values: np.ndarray, text_of: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its text."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().view(np.uint64)
    salt = mixed(np.arange(1, len(sizes) + 1, dtype=np.uint64))
    return np.isin(mixed(values ^ salt[text_of]), mixed(flat ^ np.repeat(salt, sizes)))


class Windows:
    """The windows of a slice of texts: where those of the asked length start, the text of
    each, and where its window of each level starts."""

    def __init__(self, column: pa.Array, sizes: list[int]):
        texts, length = Texts(column), sizes[-1]
        self.words, self.first = texts.words(), texts.first
        n = max(0, len(self.words) - length + 1)
        self.at = np.flatnonzero(starts(texts.first, length)[:n])
        self.text_of = np.searchsorted(texts.first, self.at, "right") - 1
        self.anchor = lowest_at(rolled(self.words, sizes[0]), length - sizes[0] + 1, n)[self.at]
        self.last = self.at + length

    def placed(self, size: int) -> np.ndarray:
        """Where the window of a level inside each window of the asked length starts."""
        return np.minimum(self.anchor, self.last - size)


def remove_repeats(docs: DataFrame, length: int = 13, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, spans (first and last word of each
    removed run), kept (the kept words, joined by one space).

    Words are runs without ASCII white space, unchanged.  A word goes if a window of
    `length` words covers it whose words also start in a document of smaller id; windows
    are judged on the input.  Texts of fewer words lose none; null texts are empty.  Rows
    with equal ids are one document here: they do not remove from each other.  A null id
    is neither smaller nor larger than any, so such rows stay whole.  Other columns go.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows of one id are told apart by their texts
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 32).alias("mark"))
    named, sizes = rows.where("id is not null"), levels(length, shortest)

    def entries(level: int):
        """Hashes of a level's windows, as far as the level before survives in the text."""
        last = level == len(sizes) - 1

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                seen = Windows(batch.column("text"), sizes)
                placed, text_of = seen.placed(sizes[level]), seen.text_of
                if level:
                    before = rolled(seen.words, sizes[level - 1])
                    asked = member(before[seen.placed(sizes[level - 1])], text_of, batch.column("hs"))
                    placed, text_of = placed[asked], text_of[asked]
                new = np.ones(len(placed), bool)
                new[1:] = placed[1:] != placed[:-1]
                placed, text_of = placed[new], text_of[new]
                columns = [rolled(seen.words, sizes[level])[placed].view(np.int64), batch.column("id").to_numpy()[text_of]]
                if last:
                    more = rolled(seen.words, sizes[level], OTHER)[placed] >> np.uint64(33)
                    columns += [more.astype(np.int32), batch.column("mark").to_numpy()[text_of] + placed - seen.first[text_of]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "id", "g", "mark"][: len(columns)])

        return kernel, "h long, id long, g int, mark long" if last else "h long, id long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            lists, counts = batch.column("marks"), np.diff(texts.first)
            text_of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() - batch.column("mark").to_numpy()[text_of]
            own = (at >= 0) & (at < 1 << 32)  # marks of another text of this id are not
            at = at[own] + texts.first[text_of[own]]
            gone = np.zeros(len(texts.starts) + 1, np.int32)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
            covered = np.cumsum(gone)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[texts.first])
            kept, spans = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words, found = text.split(), []
                if removed[i]:
                    here = covered[texts.first[i] : texts.first[i + 1]]
                    words = compress(words, (~here).tolist())
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                    found = [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]
                kept.append(b" ".join(words))
                spans.append(found)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(removed.astype(np.int64)), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])

    source, asked = named, None
    for level in range(len(sizes)):
        kernel, shape = entries(level)
        found = scratch.table(source.mapInArrow(kernel, shape), f"windows-{level}")
        if asked is not None:
            scratch.drop(f"asked-{level - 1}")
        by = ["h", "g"] if level == len(sizes) - 1 else ["h"]
        ends = found.groupBy(*by).agg(F.min("id").alias("least"), F.max("id").alias("most"))
        again = scratch.table(ends.where("least < most").select(*by, "least"), f"again-{level}")
        if level == len(sizes) - 1 or again.isEmpty():
            break
        # the texts with their surviving windows go to the next level
        asked = scratch.table(found.join(again.select("h"), "h").groupBy("id").agg(F.collect_set("h").alias("hs")), f"asked-{level}")
        scratch.drop(f"windows-{level}", f"again-{level}")
        source = named.join(asked, "id")
    if level == len(sizes) - 1:
        later = found.join(again, by).where("id > least")
        marked = scratch.table(later.groupBy("id").agg(F.collect_set("mark").alias("marks")), "marked")
    else:
        marked = scratch.table(found.where("false").groupBy("id").agg(F.collect_set("h").alias("marks")), "marked")
    scratch.drop(f"windows-{level}", f"again-{level}")
    whole = rows.join(marked, "id", "left").select("id", "text", "mark", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))
    return whole.mapInArrow(cut, "id long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept string").withColumnRenamed("id", id_col)
