"""Licence scans with DataFrame functions alone.

A text that holds none of the gate's words is only counted.  In the others the words are
joined by single spaces; a rule is tried where its keyword stands, its matches become
intervals of words, and an interval inside another one of higher priority (of equal
priority: a longer one, then an earlier rule's) is suppressed: in the order of their
starts, longest first, an interval lies inside an earlier one exactly if one of those ends
no sooner.  Everything happens within the row, so nothing is shuffled and no text leaves
its task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OPEN, SHUT = "\x01", "\x02"
#: Every match of a rule, with the space before and after it, holds one of these.
GATE = ("licen", "gpl", "spdx", "copyright", "redistribut", "permission", "warrant", "apache", "mozilla", "eclipse", "commons", "reserved", "proprietary", "prohibited", "domain", "bsd", "gnu", "endorse", "advertising", "misrepresented", "wtfpl", "consortium", "openssl", "beer", "blessing", "disclaimer", "perl", " mpl", " epl", " cc ", " cc0 ", " ofl ", "ed under ", "le under ", "you under ")
#: Detections folded at once.
CHUNK = 128


def may_match(joined: Column) -> Column:
    """Whether any rule can match the joined words."""
    gate = F.contains(joined, F.lit(GATE[0]))
    for part in GATE[1:]:
        gate = gate | F.contains(joined, F.lit(part))
    return gate


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, detections (label, priority, first and last word; those not suppressed).

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased.
    n_base counts the places of base phrases, first_word and last_word are the smallest
    and the largest word number where one starts (null without any).  score is the
    greatest confidence of a detection that is not suppressed, 0 without any.  Null and
    empty texts have no words and no labels; repeated rows stay; other columns go.
    """
    ranks = sorted({r[1] for r in rules()})
    ranks = sorted({r[1] for r in rules()})
    fields = ("label", "priority", "rank", "confidence", "keywords", "rx", "rule")
    listed = [(label, priority, ranks.index(priority), confidence, keyword.split("|"), f"(?<= )(?:{pattern})(?= )", i) for i, (label, priority, confidence, keyword, pattern) in enumerate(rules())]
    # one constant, which the optimizer folds
    shape = "array<struct<label: string, priority: int, rank: int, confidence: double, keywords: array<string>, rx: string, rule: int>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(fields, x)) for x in listed])), shape)
    keywords = F.split(F.lit("|".join(sorted({k for x in listed for k in x[4]}))), "\\|")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), F.lit(GAP), F.lit(" ")))
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), body, F.lit(" ")).alias("joined"))
    # two spaces around no words, else one more than there are words
    spaces = F.length("joined") - F.length(F.replace(F.col("joined"), F.lit(" "), F.lit("")))
    rows = rows.withColumns({"n_words": F.when(F.length("joined") == 2, 0).otherwise(spaces - 1).cast("long"), "open": may_match(F.col("joined"))})
    rows = rows.withColumn("joined", F.when(F.col("open"), F.col("joined")).otherwise("")).drop("open")
    rows = rows.withColumn("words", F.when(F.col("joined") != "", F.split(F.trim("joined"), " ", -1)))
    # base places: where the last word of a phrase is, less the words before it
    rows = rows.withColumn("places", F.when(F.instr("joined", " license ") > 0, F.expr("""
        filter(transform(words, (w, i) -> case when w != 'license' then null
            when get(words, i - 1) = 'mit' then struct(i - 1 as place, 'mit' as label)
            when get(words, i - 1) = 'apache' then struct(i - 1 as place, 'apache' as label)
            when get(words, i - 1) = 'public' and get(words, i - 2) = 'general' then struct(i - 2 as place, 'gpl' as label) end), x -> x is not null)""")))
    rows = rows.withColumn("present", F.filter(keywords, lambda k: F.contains(F.col("joined"), k)))
    tried = F.filter(table, lambda r: F.arrays_overlap("present", r.keywords) & F.regexp_like("joined", r.rx))
    rows = rows.withColumn("tried", F.when(F.size("present") > 0, tried))
    rows = rows.withColumn("found", F.flatten(F.transform("tried", _intervals)))
    rows = rows.withColumn("found", F.array_sort("found")).withColumn("detections", _not_inside(len(ranks)))
    base = F.coalesce(F.transform("places", lambda x: x.label), F.array().cast("array<string>"))
    own = F.coalesce(F.transform("detections", lambda x: x.label), F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x.place)).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x.place)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x.confidence)), F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("detections", lambda x: F.struct(x.label.alias("label"), (-x.minus_priority).alias("priority"), x["first"].alias("first_word"), (-x.minus_last).alias("last_word"))), F.array().cast("array<struct<label: string, priority: int, first_word: int, last_word: int>>")).alias("detections"),
    )


def _intervals(rule: Column) -> Column:
    """First and last words of a rule's matches: the matches are marked in the joined
    words, and the marks' places are those of the words that carry them."""
    marked = F.split(F.trim(F.regexp_replace(F.col("joined"), rule.rx, F.lit(f"{OPEN}$0{SHUT}"))), " ", -1)
    first = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(OPEN)), i)), lambda i: i.isNotNull())
    last = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit(SHUT)), i)), lambda i: i.isNotNull())
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (-b).alias("minus_last"), (-rule.priority).alias("minus_priority"), rule.rule.alias("rule"), rule["rank"].alias("rank"), rule.confidence.alias("confidence"), rule.label.alias("label")))


def _not_inside(ranks: int) -> Column:
    """The sorted detections less those inside an earlier one of equal or higher priority.

    ends[k] is the furthest end so far among priorities of rank k and more.  Chunks keep
    the copying of the growing result short.
    """
    step = f"""(state, d) -> named_struct(
        'ends', if(state.ends[d.rank] >= -d.minus_last, state.ends, transform(state.ends, (x, k) -> if(k <= d.rank, greatest(x, -d.minus_last), x))),
        'kept', if(state.ends[d.rank] >= -d.minus_last, state.kept, concat(state.kept, array(d))))"""
    chunk = f"aggregate(slice(found, c * {CHUNK} + 1, {CHUNK}), named_struct('ends', all.ends, 'kept', slice(found, 1, 0)), {step})"
    whole = f"""aggregate(sequence(0, cast((size(found) - 1) div {CHUNK} as int)),
        named_struct('ends', array_repeat(-1, {ranks}), 'chunks', array(slice(found, 1, 0))),
        (all, c) -> element_at(transform(array({chunk}), x -> named_struct('ends', x.ends, 'chunks', concat(all.chunks, array(x.kept)))), 1),
        all -> flatten(all.chunks))"""
    return F.when(F.size("found") > 0, F.expr(whole))
