"""Token counts.

Each text is cut into pre-tokens where it lies.  The number of tokens of a frequent
pre-token comes from a broadcast table: two arrays, of hashes and of lengths, in which a
pre-token has one place, so that a whole slice of texts is looked up at once.  Which
pre-tokens are frequent is told by a bounded sample; it decides about speed alone.  A
pre-token that misses the table goes through the worker's cache, which encodes what it has
not seen.  Nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACED, UNUSUAL, Bpe, Cache
from .slices import BASE, LENGTH, mixed, powers, slices

#: Entries that a worker caches, in each of two generations.
CACHED = 200_000
#: The table: so many places, for at most so many pre-tokens, told by the first rows of the
#: corpus, so many at most and so many characters of each.
PLACES, FREQUENT, SAMPLE, SAMPLE_CHARS = 1 << 18, 1 << 16, 2000, 4000
_counters: dict = {}


def hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of characters between these ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * LENGTH * BASE)


def frequent(texts: list[str], path: str, places: int = PLACES, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The table: at each place the hash of a pre-token, and its number of tokens (0: none).
    Of two pre-tokens with one place the more frequent has it."""
    bpe, split, seen = Bpe(path), regex.compile(SPACED), Counter()
    for text in texts:
        if not UNUSUAL.search(text):
            seen.update(split.findall(text))
    keys, counts = np.zeros(places, np.uint64), np.zeros(places, np.uint16)
    for piece, _ in sorted(seen.most_common(most), key=lambda x: (-x[1], x[0])):
        key = hashes(piece, np.array([len(piece)]))[0]
        at, n = int(key) % places, len(bpe.one(piece.encode()))
        if not counts[at] and n < 1 << 16:
            keys[at], counts[at] = key, n
    return keys, counts


class Lookup:
    """Numbers of tokens of whole texts; hits and misses count pre-tokens."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray], cached: int = CACHED):
        self.keys, self.counts = table
        self.bpe, self.split = Bpe(path), regex.compile(SPACED)
        self.cache = Cache(lambda pre_token: len(self.bpe.one(pre_token.encode())), cached)
        self.special, self.hits, self.misses = list(self.bpe.special), 0, 0

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """As the library's default: strings of special tokens inside a text count one."""
        out, plain, pieces, cuts = np.zeros(len(texts), np.int64), [], [], [0]
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.special) or UNUSUAL.search(text):
                out[i] = len(self.bpe.library_ids(text))
                continue
            plain.append(i)
            pieces += self.split.findall(text)
            cuts.append(len(pieces))
        if plain:
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            key = hashes("".join(texts[i] for i in plain), ends)
            at = (key % np.uint64(len(self.keys))).astype(np.int64)
            counts = np.where(self.keys[at] == key, self.counts[at], 0).astype(np.int64)
            missed = np.flatnonzero(counts == 0).tolist()
            counts[missed] = [self.cache[pieces[k]] for k in missed]
            self.hits, self.misses = self.hits + len(pieces) - len(missed), self.misses + len(missed)
            out[plain] = np.add.reduceat(counts, cuts[:-1])
        return out


def token_counts(docs: DataFrame, path: str, limit: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit); a null id stays
    null; repeated rows stay repeated; other columns of docs are ignored.  sample, the
    number of rows that tell frequent pre-tokens, changes no result.
    """
    spark = docs.sparkSession
    some = docs.select(F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS).alias("text")).limit(sample).collect()
    table = spark.sparkContext.broadcast(frequent([r.text for r in some if r.text], path))
    kind, name = docs.schema[id_col].dataType, (path, uuid.uuid4().hex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _counters.get(name)
        if lookup is None:
            _counters.clear()
            lookup = _counters[name] = Lookup(path, table.value)
        for batch in slices(batches):
            texts = batch.column("text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n_tokens = lookup(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
