"""SimHash near-duplicates.

Fingerprints are 64 bits over word shingles.  Equal fingerprints form a class; classes
whose fingerprints differ in at most `most` bits agree wholly on all but `most` of the
blocks that the 64 bits are split into, so each choice of the agreeing blocks is a
table, rows that share a table's key meet, and the Hamming distance decides.  A table's
bucket that is too large is split by the same principle: the bits outside its key make
most + 1 blocks, of which close pairs share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch
from signweave.operators.components import connected_components

from .blocks import HOT, grouped, linked_stars
from .slices import Texts, slices

SEED = 42
#: Eight one-byte counters, one for each bit of a byte.
SPREAD = sum((((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b)) for b in range(8))


def shingle_hashes(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of so many words, joined by single spaces, and where each text's start."""
    first, starts, ends = texts.first, texts.starts, texts.ends
    inner = np.ones(len(starts), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    keep, data = np.zeros(len(texts.data) + 1, bool), texts.data.copy()
    keep[: len(texts.data)] = inside(texts)
    gaps = starts[inner] - 1
    keep[gaps], data[gaps] = True, 32
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    joined = data[keep[:-1]].tobytes()
    n = np.diff(first)
    runs = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], runs) + np.repeat(first[:-1], runs)
    last = np.minimum(begin + words - 1, np.repeat(first[1:], runs) - 1)
    a, b, digest = place[starts[begin]].tolist(), place[ends[last]].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a)), at


def inside(texts: Texts) -> np.ndarray:
    edge = np.zeros(len(texts.data) + 1, np.int8)
    edge[texts.starts] += 1
    edge[texts.ends] -= 1
    return np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)


def majority(hashes: np.ndarray, at: np.ndarray, rows: int = 255) -> np.ndarray:
    """A bit is set if it is set in over half the hashes of a text; no hashes, zero."""
    n = np.diff(at)
    chunks = -(-n // rows)
    chunk_at = np.concatenate([[0], np.cumsum(chunks)])
    begins = (np.arange(chunk_at[-1]) - np.repeat(chunk_at[:-1], chunks)) * rows + np.repeat(at[:-1], chunks)
    out = np.zeros(len(n), np.uint64)
    if not len(begins):
        return out
    lanes = np.add.reduceat(SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], begins, axis=0)
    counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 64).astype(np.int64)
    full = np.flatnonzero(n)
    bits = np.add.reduceat(counts, chunk_at[full], axis=0) * 2 > n[full, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; null and wordless texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = majority(*shingle_hashes(Texts(batch.column("text"), lower=True), words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(mark, f"id {kind}, fp long")


def block_masks(most: int, spare: int = 2) -> list[int]:
    """Masks of `spare` whole blocks out of most + spare: close pairs agree under one at least."""
    n = most + spare
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def finer_masks(masks: list[int], most: int) -> list[int]:
    """Each mask with one of the most + 1 blocks of the bits outside it: close pairs that
    agree under a mask agree under one of these; those of mask t stand from t * (most + 1)."""
    found = []
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        cuts = [len(free) * i // (most + 1) for i in range(most + 2)]
        found += [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
    return found


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def under(masks: list[int], t: Column, fp: Column) -> Column:
    """fp under the mask of number t."""
    return fp.bitwiseAND(F.get(F.array(*(F.lit(signed(m)).cast("long") for m in masks)), t))


def components(classes: DataFrame, most: int, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(fp, component) of the distinct fingerprints that have a close one; component is the
    smallest fingerprint, as a signed number, that hangs together with it."""
    masks = block_masks(most)
    each = lambda rows, first, masks: rows.withColumn("t", F.explode(first)).select("t", under(masks, F.col("t"), F.col("id")).alias("key"), "id")
    entries = each(classes.select(F.col("fp").alias("id")), F.sequence(F.lit(0), F.lit(len(masks) - 1)), masks)
    finer, level = [], masks
    for _ in range(2):
        level = finer_masks(level, most)
        begin = F.col("t") * (most + 1)
        finer.append(lambda rows, begin=begin, level=level: each(rows, F.sequence(begin, begin + most), level))
    close = lambda x, y: np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= most
    found = linked_stars(grouped(entries, scratch, finer, hot=hot), close, lambda x, y: close(x[:, None], y[None, :]))
    pairs = scratch.table(found.distinct(), "links")
    return connected_components(pairs, "id", "low").withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id whose fingerprint is reached by steps of at most
    `most` differing bits.  Null and wordless texts have fingerprint zero and hang
    together like any others.  Repeated rows stay, with equal results; a null id is never
    a component's smallest id unless all of its ids are null.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.table(fingerprints(docs, words, id_col, text_col), "marks")
    classes = scratch.table(marks.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    # links are between fingerprints; components are numbered by the smallest id
    named = scratch.table(components(classes, most, scratch, hot).join(classes, "fp"), "named")
    least = scratch.table(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    moved = scratch.table(named.join(least, "component").select("fp", "least"), "moved")
    whole = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    placed = marks.join(scratch.table(whole, "whole"), "fp")
    scratch.drop("classes", "named", "least", "moved", "links")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return placed.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
