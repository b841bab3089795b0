"""The corpus pipeline: each stage calls one operator and acts on what it finds.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet
and read again as the next one's docs; all but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch
from signweave.llm import lines, mixing, packing, quality, simhash
from signweave.llm.queries import DOMAIN, TARGETS

#: Ids that are broadcast at most.
BROADCAST = 2_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3 go; texts stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, lambda c: quality.fold(c) != 0, "quality")
    return quality.scores(docs.select(COLUMNS), model, COLUMNS).where(F.col("score") >= 0.3).drop("score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; every document stays, with n_chars of what is left."""
    found = lines.drop_recurring_lines(docs.select(COLUMNS))
    return found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Of rows that repeat that id in one group one stays, the first in order of text; rows
    of one id in several groups are several documents.  Rows without an id cannot be told
    apart and stay.
    """
    if repeated(docs):
        return one_of_each(spark, docs).unionByName(docs.where("doc_id is null").select(COLUMNS))
    found = simhash.near_duplicates(docs.select("doc_id", "text"), most=4, words=4)
    gone = Scratch(spark, "gone").table(found.where("doc_id != component_id").select("doc_id"), "ids")
    # texts stay in place while the counted ids fit; rows without an id match none
    small = gone.count() <= BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The first row, by id and text, of each group of near-duplicates that has an id.

    Ids repeat, so a row is known by its id and its text's hash, null ids last; a group is
    named by its least such pair.
    """
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash"))
    marked = docs.select(COLUMNS).withColumn("own", own)
    found = simhash.near_duplicates(marked, most=4, words=4, id_col="own")
    kept = found.where("own.doc_id = component_id.doc_id").select("own", "component_id").distinct()
    kept = Scratch(spark, "kept").table(kept, "ids")
    first = F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("first")
    return marked.join(kept, "own").groupBy("component_id").agg(first).select("component_id.doc_id", "first.*").select(COLUMNS)


def repeated(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate asks for."""
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr(DOMAIN).alias("domain"))
    mixed = mixing.mix(docs.select(COLUMNS), labelled, TARGETS)
    # outer, so that no filter on the rate is inferred and computed below the memberships
    copies = F.explode_outer(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies"))))
    return mixed.withColumn("copy", copies).where("copy is not null").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, room=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_to_targets),
    ("packing", pack),
]

#: Subword training, fingerprints and byte-pair encoding are beyond SQL; tests hold run()
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
