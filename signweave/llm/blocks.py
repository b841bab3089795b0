"""Pairs that share a bucket, verified group by group, never listed.

Rows that share (t, key) meet.  A bucket of more than HOT rows is split into finer ones
where the caller knows an exact way; what is still larger than BLOCK is dealt into
blocks, and each pair of its blocks makes a group, so no task holds a whole bucket.
Pairs of small groups are compared all at once, larger groups strip by strip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch

#: Rows of a block, rows beyond which a bucket is split, and rows of a small group.
BLOCK, HOT, SMALL, STRIP = 2048, 4096, 16, 256


def grouped(entries: DataFrame, scratch: Scratch, finer: list[Callable[[DataFrame], DataFrame]] = [], block: int = BLOCK, hot: int = HOT) -> DataFrame:  # noqa: B006
    """entries (t int, key long, id long): those that share a bucket with another, once
    for each group that they belong to: t, key, id, b (own block), lo, hi (the group's).

    finer[k] turns the entries of hot buckets into entries of finer buckets, in which every
    pair that matters still meets.
    """
    parts = []
    for level in range(len(finer) + 1):
        sizes = scratch.table(entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{level}")
        met = entries.join(sizes, ["t", "key"])
        done = level == len(finer) or sizes.where(F.col("n") > hot).isEmpty()
        m = F.ceil(F.col("n") / block).cast("int")
        here = (met if done else met.where(F.col("n") <= hot)).withColumn("m", m).withColumn("b", F.pmod(F.xxhash64("id"), "m").cast("int"))
        each = here.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        parts.append(each.select("t", "key", "id", "b", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi")))
        if done:
            break
        entries = scratch.table(finer[level](met.where(F.col("n") > hot).select("t", "key", "id")), f"entries-{level + 1}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def dealt(groups: DataFrame) -> DataFrame:
    """The rows of each group together and in order."""
    return groups.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "id")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("t", "key", "lo", "hi")) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups: a batch, and where its groups start, and its end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = bounds(batch, keys)
        if rest and len(cuts) == 2 and same(rest[-1], batch, keys):
            rest.append(batch)  # a group that goes on is not joined again each time
            continue
        whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0] if rest else batch
        cuts = bounds(whole, keys) if rest else cuts
        if len(cuts) > 2:
            yield whole.slice(0, int(cuts[-2])), cuts[:-1]
        rest = [whole.slice(int(cuts[-2]))]
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        yield whole, np.array([0, whole.num_rows])


def same(a: pa.RecordBatch, b: pa.RecordBatch, keys: tuple[str, ...]) -> bool:
    return all(a.column(k)[-1] == b.column(k)[0] for k in keys)


def bounds(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in keys:
        x = batch.column(key).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def lowest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row it hangs together with."""
    n = len(linked)
    labels = np.arange(n)
    while True:
        offered = np.concatenate([np.where(linked[a : a + STRIP], labels[None, :], n).min(axis=1) for a in range(0, n, STRIP)])
        new = np.minimum(labels, offered)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def links(batch: pa.RecordBatch, cuts: np.ndarray, pairwise: Callable, crosswise: Callable) -> Iterator[tuple[np.ndarray, np.ndarray] | tuple[int, np.ndarray]]:
    """The links of a batch of groups: for all small groups (i, j), the linked rows; for
    each larger group (a, matrix), its first row and its symmetric matrix of links.

    pairwise(i, j) judges pairs of rows, crosswise(a, b, c, d) rows a to b against c to d.
    Rows of one block are not compared again in the groups of two blocks.
    """
    own, cross = batch.column("b").to_numpy(), batch.column("lo").to_numpy() != batch.column("hi").to_numpy()
    sizes = np.diff(cuts)
    for n in range(2, SMALL + 1):
        begin = cuts[:-1][sizes == n]
        if len(begin):
            i, j = (np.add.outer(begin, x).ravel() for x in np.triu_indices(n, 1))
            meant = ~cross[i] | (own[i] != own[j])
            i, j = i[meant], j[meant]
            near = pairwise(i, j)
            if near.any():
                yield i[near], j[near]
    for a, b in zip(cuts[:-1][sizes > SMALL].tolist(), cuts[1:][sizes > SMALL].tolist()):
        linked = np.concatenate([crosswise(s, min(b, s + STRIP), a, b) for s in range(a, b, STRIP)])
        if cross[a]:
            linked &= own[a:b, None] != own[None, a:b]
        np.fill_diagonal(linked, False)
        if linked.any():
            yield a, linked


def linked_stars(groups: DataFrame, pairwise: Callable, crosswise: Callable) -> DataFrame:
    """(id, low): links that hang the same ids together as all pairs that are judged close;
    pairwise and crosswise take the arrays of ids on both sides."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in runs(batches):
            ids = batch.column("id").to_numpy()
            found_a, found_b = [], []
            for x, y in links(batch, cuts, lambda i, j: pairwise(ids[i], ids[j]), lambda a, b, c, d: crosswise(ids[a:b], ids[c:d])):  # noqa: B023
                if isinstance(x, np.ndarray):
                    found_a.append(ids[y])
                    found_b.append(ids[x])
                else:
                    low = lowest(y)
                    moved = np.flatnonzero(low != np.arange(len(low)))
                    found_a.append(ids[x + moved])
                    found_b.append(ids[x + low[moved]])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["id", "low"])

    return dealt(groups).mapInArrow(kernel, "id long, low long")
