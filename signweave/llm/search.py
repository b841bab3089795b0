"""Exact top-k by inner product over a bit-sliced index.

Rows lie in blocks.  A block's index holds, for every attribute, the most significant
bits of its quantised values as bitmaps over the rows.  For a query the weighted bit
slices are added with bitmap arithmetic to the slices of an approximate score; walking
these from the most significant slice down finds the k-th best approximate score, a
bound on the error tells which rows lie near that boundary or above it, and only their
scores are computed exactly.  Nothing is lost: the bound holds for every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signweave.functions.scratch import Scratch

from .blocks import runs

#: Bits kept of a row's values and of a query's weights.
ROW_BITS, QUERY_BITS = 5, 4
#: Rows of a block and queries that one built index answers, at most, and numbers in a block
#: of rows.
ROWS, QUERIES, NUMBERS = 32768, 8192, 1 << 22


class Index:
    """Bit slices of one block of rows (whole numbers, rows x attributes)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bits: int = ROW_BITS):
        self.ids, self.rows, self.n = ids, rows, len(ids)
        self.low = rows.min(axis=0)
        span = int((rows - self.low).max(initial=0))
        self.shift = max(0, span.bit_length() - bits)
        kept = (rows - self.low) >> self.shift
        self.bits = max(1, int(kept.max(initial=0)).bit_length())
        # what quantising has cut off, from its middle value
        rest = (rows - self.low - (kept << self.shift)).astype(np.float64) - ((1 << self.shift) - 1) / 2
        self.rest = float(np.sqrt((rest * rest).sum(axis=1)).max(initial=0))
        self.norm = float(np.sqrt((kept.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        words = -(-self.n // 64)
        self.slices = np.zeros((rows.shape[1], self.bits, words), np.uint64)
        for b in range(self.bits):
            packed = np.packbits((kept.T >> b) & 1, axis=1, bitorder="little").astype(np.uint8)
            whole = np.zeros((rows.shape[1], words * 8), np.uint8)
            whole[:, : packed.shape[1]] = packed
            self.slices[:, b] = whole.view(np.uint64)
        self.all = np.zeros(words * 8, np.uint8)
        ones = np.packbits(np.ones(self.n, bool), bitorder="little")
        self.all[: len(ones)] = ones
        self.all = self.all.view(np.uint64)

    def near_top(self, query: np.ndarray, k: int, bits: int = QUERY_BITS) -> np.ndarray:
        """Numbers of rows among which the k highest exact scores surely are."""
        span = int(np.abs(query).max(initial=0))
        shift = max(0, span.bit_length() - bits)
        weights = (np.abs(query) >> shift) * np.sign(query)
        approximate = self.sum(weights)
        # score = 2^(both shifts) * approximate + what depends on the query alone + error
        left = (query - (weights << shift)).astype(np.float64)
        scale = float(1 << (self.shift + shift))
        error = np.sqrt((left * left).sum()) * self.norm * (1 << self.shift) + np.sqrt((query.astype(np.float64) ** 2).sum()) * self.rest
        bound = self.kth(approximate, k)
        # a margin for the floating arithmetic of the bound itself
        return self.at_least(approximate, bound - int(np.ceil(2 * (error * (1 + 1e-9) + 1) / scale)))

    def sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(weights * kept) less its least value, by carry-save adders.

        A negative weight counts the complement of each slice, which adds a constant.
        """
        size = np.abs(weights)
        own = self.slices ^ np.where(weights < 0, ~np.uint64(0), np.uint64(0))[:, None, None]
        columns: list[list[np.ndarray]] = [[] for _ in range(int(size.max(initial=0)).bit_length() + self.bits)]
        for w in range(int(size.max(initial=0)).bit_length()):
            chosen = np.flatnonzero(size >> w & 1)
            for b in range(self.bits):
                columns[w + b].append(own[chosen, b])
        out, p = [], 0
        while p < len(columns):
            column, carried = np.concatenate([*columns[p], np.zeros((0, len(self.all)), np.uint64)]), []
            while len(column) > 2:  # three bitmaps become a sum and a carry, many at once
                m = len(column) // 3
                a, b, c = column[:m], column[m : 2 * m], column[2 * m : 3 * m]
                both = a ^ b
                carried.append((a & b) | (both & c))
                column = np.concatenate([both ^ c, column[3 * m :]])
            if len(column) == 2:
                carried.append(column[:1] & column[1:])
                column = column[:1] ^ column[1:]
            if carried:
                if len(columns) == p + 1:
                    columns.append([])
                columns[p + 1] += carried
            out.append(column[0] if len(column) else np.zeros_like(self.all))
            p += 1
        return out

    def kth(self, total: list[np.ndarray], k: int) -> int:
        """The k-th highest value (the lowest if there are fewer rows)."""
        among, above, value = self.all, 0, 0
        for p in range(len(total) - 1, -1, -1):
            ones = among & total[p]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= min(k, self.n):
                among, value = ones, value | 1 << p
            else:
                above, among = above + n, among & ~total[p]
        return value

    def at_least(self, total: list[np.ndarray], value: int) -> np.ndarray:
        if value <= 0:
            return np.arange(self.n)
        over, same = np.zeros_like(self.all), self.all
        for p in range(len(total) - 1, -1, -1):
            if value >> p & 1:
                same = same & total[p]
            else:
                over = over | (same & total[p])
                same = same & ~total[p]
        if value >> len(total):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.unpackbits((over | same).view(np.uint8), bitorder="little")[: self.n])


def top_scores(index: Index, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows but the query's own: ids and exact scores; ties to the smaller id."""
    at = index.near_top(query, k + int(np.count_nonzero(index.ids == own)))
    at = at[index.ids[at] != own]
    scores = index.rows[at] @ query
    best = np.lexsort((index.ids[at], -scores))[:k]
    return index.ids[at][best], scores[best]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, rows: int = ROWS, queries: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: for each row whose id is divisible by `every`, the k
    other rows of highest inner product of floor(scale * component).

    Rows that are null, empty or hold a null or non-finite component, or whose id is null,
    take no part; shorter vectors count as if filled up with zeros.  Repeated rows count
    as rows; rows with the query's own id are not its candidates, and a query id that
    stands more than once is asked once per distinct vector and answered with the best of
    all.  Scores are exact while they fit 64 bits.  Fewer than k candidates: all of them.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    fine = "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec")).where(fine)
    whole = whole.select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    table = scratch.table(whole, "rows")
    asked = scratch.table(table.where(F.pmod("id", F.lit(every)) == 0).distinct(), "asked")
    n, dim = table.agg(F.count("*"), F.max(F.size("vec"))).first()
    rows = max(1, min(rows, NUMBERS // (dim or 1)))  # long vectors, smaller blocks
    nr, nq = max(1, -(-n // rows)), max(1, -(-asked.count() // queries))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    row_side, query_side = table.withColumn("r", dealt(nr)), asked.withColumn("q", dealt(nq))
    left = row_side.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("asks", F.lit(False))
    right = query_side.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("asks", F.lit(True))
    both = left.unionByName(right).repartition("r", "q").sortWithinPartitions("r", "q", "asks", "id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in runs(batches, ("r", "q")):
            ids, asks = batch.column("id").to_numpy(), np.array(batch.column("asks"))
            lists = batch.column("vec")
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                matrix, m = filled(lists.slice(a, b - a)), int((~asks[a:b]).sum())
                if not m or m == b - a:
                    continue
                index, out = Index(ids[a : a + m], matrix[:m]), [[], [], []]
                for own, query in zip(ids[a + m : b].tolist(), matrix[m:]):
                    found, scores = top_scores(index, query, own, k)
                    for have, x in zip(out, (np.full(len(found), own), found, scores)):
                        have.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query_id", "id", "score"])

    best = both.mapInArrow(answer, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def filled(lists: pa.Array) -> np.ndarray:
    """Whole numbers, rows x attributes, shorter rows filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out
