"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Equal vectors of one label form a class, which stands for its copies throughout.  In
each table a class's unit vector is projected on random directions, shifted, divided by
the bucket width and floored; classes of one label and dimension whose quantised
projections all agree meet, in blocks, and the cosine in double precision decides.  A
pair counts in the first table where it meets, so links are counted without listing
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signweave.functions.scratch import Scratch
from signweave.operators.components import connected_components

from .blocks import dealt, grouped, links, lowest, runs
from .slices import mixed

#: For a cosine of 0.98 (distance 0.2 of unit vectors) one projection agrees with
#: probability 0.90, a table of 12 with 0.28, one of 24 tables with 0.9997; for the
#: distance of unrelated vectors (1.2 and more) a table agrees with less than 0.0001.
TABLES, PROJECTIONS, WIDTH, SEED = 24, 12, 1.6, 7


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_keys(units: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Keys (rows x tables), the same wherever they are computed."""
    draw = np.random.Generator(np.random.PCG64([seed, units.shape[1]]))
    directions = draw.standard_normal((units.shape[1], tables * projections))
    shifts = draw.uniform(0, width, tables * projections)
    cells = np.floor((np.einsum("ij,jk->ik", units, directions) + shifts) / width).astype(np.int64).view(np.uint64)
    keys = np.zeros((len(units), tables), np.uint64)
    for k in range(projections):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cells.reshape(len(units), tables, projections)[:, :, k] + np.uint64(k))
    return keys


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and of equal length can link.  A vector that
    is null, empty, zero or holds a null or non-finite component, or whose label is null,
    has no links and is its own component.  Repeated rows are vectors of their own.
    Ids are whole numbers; a null id stays null and leads no component.  Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    element = vectors.schema[vec_col].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    fine = "label is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x != 0)"
    ok = rows.where(fine)
    # classes form on labels and vectors themselves; after that a 64-bit hash names a class
    grouped_rows = ok.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(grouped_rows.select(F.xxhash64("label", F.size("vec"), "vec").alias("id"), "rep", "copies", "label", "vec"), "classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt, lists = batch.column("salt").to_numpy(), batch.column("vec")
            for dim, at, units in by_dim(lists):
                found = mixed(table_keys(units, tables, projections, width, seed) ^ salt[at, None].view(np.uint64))
                t = np.tile(np.arange(tables, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy()[at], tables))], names=["t", "key", "id"])

    salted = classes.select("id", F.xxhash64("label", F.size("vec")).alias("salt"), "vec")
    entries = scratch.table(salted.mapInArrow(keys, "t int, key long, id long"), "entries")
    bodies = scratch.table(salted.join(classes.select("id", "copies"), "id"), "bodies")
    met = grouped(entries, scratch).join(bodies, "id")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in runs(batches):
            ids, copies, salt, ts = (batch.column(c).to_numpy() for c in ("id", "copies", "salt", "t"))
            units, dims = padded(batch.column("vec"))
            alike = lambda a, b: (salt[a] == salt[b]) & (dims[a] == dims[b])  # noqa: B023, E731
            pairwise = lambda i, j: alike(i, j) & (np.einsum("ij,ij->i", units[i], units[j]) >= cosine)  # noqa: B023, E731
            crosswise = lambda a, b, c, d: alike(np.s_[a:b, None], np.s_[None, c:d]) & (units[a:b] @ units[c:d].T >= cosine)  # noqa: B023, E731
            known: dict[int, np.ndarray] = {}

            def earlier(rows: np.ndarray) -> np.ndarray:
                """Keys of rows in all tables; a row's are computed when first asked for."""
                new = np.array([r for r in rows.tolist() if r not in known], np.int64)  # noqa: B023
                for dim in np.unique(dims[new]).tolist():  # noqa: B023
                    own = new[dims[new] == dim]  # noqa: B023
                    known.update(zip(own.tolist(), table_keys(units[own, :dim], tables, projections, width, seed)))  # noqa: B023
                return np.array([known[r] for r in rows.tolist()]).reshape(len(rows), tables)  # noqa: B023

            out: list[list[np.ndarray]] = [[], [], []]
            for x, y in links(batch, cuts, pairwise, crosswise):
                if isinstance(x, np.ndarray):
                    rows, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                    key, i, j = earlier(rows), where[: len(x)], where[len(x) :]
                    met_before = (key[i] == key[j]) & (np.arange(tables)[None, :] < ts[x, None])
                    first = ~met_before.any(axis=1)
                    for a, b in ((x, y), (y, x)):
                        out[0].append(ids[a])
                        out[1].append(np.where(first, copies[b], 0))
                        out[2].append(ids[np.minimum(a, b)])
                else:
                    n, low, t = len(y), lowest(y), int(ts[x])
                    if t:
                        key = earlier(np.arange(x, x + n))
                        for k in range(t):
                            y &= key[:, None, k] != key[None, :, k]
                    out[0].append(ids[x : x + n])
                    out[1].append(y @ copies[x : x + n])
                    out[2].append(ids[x + low])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "more", "low"])

    found = scratch.table(dealt(met).mapInArrow(links_of, "id long, more long, low long"), "found")
    scratch.drop("entries", "bodies", "sizes-0")
    more = scratch.table(found.groupBy("id").agg(F.sum("more").alias("more")), "more")
    named = scratch.table(connected_components(found, "id", "low"), "components")
    named = scratch.table(named.join(classes.select("id", "rep"), "id"), "named")
    least = scratch.table(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    moved = scratch.table(named.join(least, "component").select("id", "least"), "moved")
    whole = classes.join(more, "id", "left").join(moved, "id", "left").select("id", "copies", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("least", "rep").alias("least"))
    whole = scratch.table(whole, "whole").withColumnRenamed("id", "class")
    placed = rows.withColumn("class", F.when(F.expr(fine), F.xxhash64("label", F.size("vec"), "vec"))).select("id", "class").join(whole, "class", "left")
    component = F.coalesce("least", "id")
    return placed.select(F.col("id").alias(id_col), F.coalesce(F.col("more") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def by_dim(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Unit vectors by length: the length, the rows, the matrix."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        whole = flat if len(at) == len(sizes) else np.concatenate([flat[starts[i] : starts[i + 1]] for i in at])
        yield dim, at, unit(whole, dim)


def padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, the shorter filled up with zeros, and their lengths."""
    dims = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(dims), int(dims.max(initial=0))))
    for dim, at, units in by_dim(lists):
        out[at, :dim] = units
    return out, dims
