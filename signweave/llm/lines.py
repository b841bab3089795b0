"""Line dedup with a log-template tree.

Each line goes down a tree of fixed depth: its number of tokens, then its leading tokens
(a token with a digit is a variable field, <*>).  At a leaf, tokens that are not common
at their place among the leaf's lines are variable fields too; what is left is the
line's template.  Lines whose template recurs across documents are dropped, whatever
share of a text they are; of long lines, which are passages rather than frames of a page,
one text keeps its own.  Near copies of a text count as one document, so that the lines of
a text that was copied do not recur for that alone.

The tree is not held anywhere: leaves, tokens at a place and templates are keys of
partial sums.  Texts are read where they lie, three times: for their leaves, for their
lines of recurring leaves, and to drop lines.  What a reading needs to know, the recurring
leaves or lines, is broadcast while its counted size is within a bound; beyond it each
text is joined with its own part of it, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch

from . import simhash
from .slices import Texts, slices

DEPTH, TOKENS, DOCS, CONSTANT = 3, 4, 10, 0.5
#: Lines of so many tokens recur from so many documents on.
LONG, LONG_DOCS = 20, 3
#: Hashes that are broadcast at most (16 bytes each).
BROADCAST = 1_000_000
DIGIT, FIELD = re.compile(rb"[0-9]"), re.compile(rb"[^\x20\x09-\x0d]*[0-9][^\x20\x09-\x0d]*")


def digest(x: bytes) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def parse(line: bytes, depth: int, long: int) -> tuple[list[bytes], int]:
    """The line's tokens with its fields masked, and its leaf, whose lowest bit tells a long line."""
    tokens = (FIELD.sub(b"<*>", line) if DIGIT.search(line) else line).split()
    leaf = digest(b"%d " % len(tokens) + b" ".join(tokens[:depth]))
    return tokens, leaf | 1 if len(tokens) >= long else leaf & ~1


class Known:
    """Hashes that a reading asks for, each with the key of a text that it spares (0: none):
    broadcast, or listed beside each text."""

    def __init__(self, found: DataFrame, name: str, of_text: DataFrame, most: int):
        """found: the hashes, in a column of this name, and `spared`; of_text: key and hash,
        for each text."""
        self.name, self.value, self.lists = name, None, None
        found = found.select(name, "spared")
        if found.count() <= most:
            self.value = found.sparkSession.sparkContext.broadcast([c.to_numpy() for c in found.toArrow().combine_chunks().columns])
        else:
            self.lists = of_text.join(found, name).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(name, "spared"))).alias("known"))

    def beside(self, texts: DataFrame) -> DataFrame:
        if self.lists is None:
            return texts.withColumn("known", F.lit(None).cast("map<long, long>"))
        return texts.join(self.lists, "key", "left")


def reader(value):
    """Called with a slice, gives for each text a dictionary of hashes; value: Known's."""
    if value is None:
        return lambda batch: [dict(x or ()) for x in batch.column("known").to_pylist()]
    whole = dict(zip(*(x.tolist() for x in value.value)))
    return lambda batch: [whole] * batch.num_rows


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = TOKENS, min_docs: int = DOCS, constant: float = CONSTANT, long_tokens: int = LONG, long_docs: int = LONG_DOCS, most_bits: int = 4, broadcast: int = BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its recurring lines, and n_lines and n_dropped added.

    A line's template recurs if lines of min_docs different texts (of long_docs, if they
    have long_tokens tokens or more) have it and at least the share `constant` of its tokens
    are not fields.  Lines of recurring templates go; of a long one the text whose hash is
    lowest keeps them.  Exact and near copies of a text count once everywhere: near copies are
    SimHash components at most_bits bits of the texts with a line in a leaf that so many
    different texts share.  A token is constant at its place in a leaf if lines of as many
    texts have it there; leading tokens without digits are.  Lines of fewer than min_tokens
    tokens stay.  Null texts stay null and have no lines; repeated rows are treated alike,
    null ids as any; columns of docs stay, n_lines and n_dropped replace columns of these
    names.  broadcast bounds what is broadcast and changes no result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(text, F.lit("text"))
    keyed = docs.select(key.alias("key"), text.alias("text"))
    enough = lambda leaf: F.when(leaf.bitwiseAND(1) == 1, long_docs).otherwise(min_docs)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, keys = [], []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = {leaf for tokens, leaf in (parse(x, depth, long_tokens) for x in body.split(b"\n")) if len(tokens) >= min_tokens}
                found += own
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(keys, pa.int64())], names=["leaf", "key"])

    all_leaves = scratch.table(keyed.mapInArrow(leaves, "leaf long, key long").distinct(), "leaves")
    many = all_leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= enough(F.col("leaf"))).select("leaf", F.lit(0).cast("long").alias("spared"))
    asked = Known(scratch.table(many, "many"), "leaf", all_leaves, broadcast)
    leaves_asked = asked.value

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(leaves_asked)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            of: list[int] = []
            for i, (key, body, wanted) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), read(batch))):
                own = {}
                for x in body.split(b"\n"):
                    tokens, leaf = parse(x, depth, long_tokens)
                    if len(tokens) >= min_tokens and leaf in wanted:
                        own[b" ".join(tokens)] = leaf
                for masked, leaf in own.items():
                    for column, value in zip(out, (key, leaf, digest(masked), masked)):
                        column.append(value)
                of += [i] * len(own)
            some, where = np.unique(np.array(of, np.int64), return_inverse=True)
            marks = simhash.majority(*simhash.shingle_hashes(Texts(batch.column("text").take(pa.array(some)), lower=True), 4)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string()), pa.array(marks[where])], names=["key", "leaf", "line", "masked", "fp"])

    # the lines of those leaves, once per text; near copies are one text: `copy`
    there = scratch.table(asked.beside(keyed).mapInArrow(lines, "key long, leaf long, line long, masked string, fp long").dropDuplicates(["key", "line"]), "there")
    scratch.drop("leaves", "many")
    near = scratch.table(simhash.components(scratch.table(there.select("fp").distinct(), "fps"), most_bits, scratch), "near")
    copies = there.join(near, "fp", "left").withColumn("copy", F.coalesce("component", "fp")).select("leaf", "line", "copy", "masked")
    # a near copy's variants of a line are as many lines, each of that one text
    counted = scratch.table(copies.groupBy("leaf", "line", "copy").agg(F.first("masked").alias("masked")), "counted")
    distinct = scratch.table(counted.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("masked").alias("masked")), "distinct")
    # constant tokens of each place, then each line's template
    tokens = distinct.select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    common = tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).where((F.col("n") >= enough(F.col("leaf"))) & (F.col("token") != "<*>"))
    fixed = scratch.table(common.select("leaf", "place", "token", F.lit(1).alias("fixed")), "fixed")
    parts = tokens.join(fixed, ["leaf", "place", "token"], "left")
    shape = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed") == 1, F.col("token")).otherwise("<*>").alias("token"))))
    shaped = parts.groupBy("leaf", "line").agg(shape.alias("shape"), F.avg(F.coalesce("fixed", F.lit(0))).alias("constant"))
    templates = scratch.table(shaped.where(F.col("constant") >= constant).select("leaf", "line", F.xxhash64("leaf", F.transform("shape", lambda x: x.token)).alias("template")), "templates")
    # templates that recur, counted over texts, and their lines
    of_copy = counted.select("line", "copy").join(templates, "line")
    recurring = of_copy.select("leaf", "template", "copy").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") >= enough(F.col("leaf")))
    again = templates.join(scratch.table(recurring.select("template"), "recurring"), "template")
    # of a long one the text of lowest key keeps its lines
    long = again.where(F.col("leaf").bitwiseAND(1) == 1)
    first = there.select("key", "line").join(long.select("line", "template"), "line").groupBy("template").agg(F.min("key").alias("first"))
    spared = scratch.table(again.join(first, "template", "left").groupBy("line").agg(F.coalesce(F.min("first"), F.lit(0)).alias("spared")), "gone")
    known = Known(spared, "line", there.select("key", "line"), broadcast)
    lines_gone = known.value

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(lines_gone)
        for batch in slices(batches, "line text"):
            texts, n_lines, n_dropped = [], [], []
            for body, key, listed in zip(batch.column("line text").cast(pa.binary()).to_pylist(), batch.column("key").to_pylist(), read(batch)):
                if body is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_dropped.append(0)
                    continue
                rows = body.split(b"\n")
                kept = [row for row in rows if not goes(row, key, listed)] if listed else rows
                texts.append(b"\n".join(kept))
                n_lines.append(len(rows))
                n_dropped.append(len(rows) - len(kept))
            clean = pa.array(texts, pa.binary()).cast(pa.string())
            fixed = {"line text": clean, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            names = [*carried, "line text", "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else batch.column(c) for c in names], names=names)

    def goes(row: bytes, key: int, listed: dict) -> bool:
        tokens = (FIELD.sub(b"<*>", row) if DIGIT.search(row) else row).split()
        return len(tokens) >= min_tokens and listed.get(digest(b" ".join(tokens)), key) != key

    # other columns are carried under names that clash with none of ours
    back = {c: f"c{i}" for i, c in enumerate(others) if c != text_col}
    carried = list(back.values())
    source = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in back.items()), F.col(text_col).cast("string").alias("line text"), key.alias("key"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), "`line text` string", "n_lines long", "n_dropped long"])
    cleaned = known.beside(source).mapInArrow(drop, schema)
    scratch.drop("fps", "near", "links", "counted", "distinct", "fixed", "templates", "recurring")
    return cleaned.select(*(F.col(back[c]).alias(c) if c in back else F.col("line text").alias(c) for c in others), "n_lines", "n_dropped")
