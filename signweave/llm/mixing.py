"""Mixing documents to target domain weights, with DataFrame functions alone.

A naive Bayes classifier over tokens, fitted on a bounded sample of the labelled table,
gives every document its evidence for each domain.  Evidence of many tokens that tell the
same fact is too sure of itself, so it is calibrated: documents fall into cells by the
likeliest domain and by how far the next one is behind, and the memberships of a cell are
the domains' shares among the labelled documents in it, each judged by a classifier fitted
without its part of the sample.

The rates of documents are the nonnegative least-squares fit of the expected domain token
totals to the targets, by projected gradient from rate one.  A small ridge holds rates near
one, so that targets out of reach do not drive documents of nearly equal memberships apart.  In the metric that weighs a
document by its tokens a step lowers a document's rate by its memberships times the
domains' excess, which is the same for all documents of a cell.  So the sums over documents
are made once, by cell, on all executors; what the steps run over is bounded by the number
of domains, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signweave.functions.mixhash import bound
from signweave.functions.scratch import Scratch

#: Places in the classifier's table of tokens, and the bounded sample of labelled rows.
PLACES, SAMPLE = 1 << 13, 20_000
#: A token tells something if so many documents of the sample have it, its log odds are so
#: far from even, and the root of its likelihood ratio is so high.
LEAST_DOCS, STRONG, CLEAR = 4, 1.0, 4.0
#: Parts of the sample, each judged by a classifier fitted on the others.
PARTS = 4
#: Levels of a cell's margin, how many make one unit of evidence, and what a far one counts.
LEVELS, FINE, FAR = 32, 4, 0.01
#: The gradient ends when no domain's expected share moves by more in a step; after so many
#: steps at the latest; and shares so near to the targets count as reached.
STILL, STEPS, NEAR = 1e-12, 100_000, 0.005
#: Weight of the ridge.
RIDGE = 1e-3
PUNCTUATION, SPACE = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", r"[\x00-\x20]+"


def tokens_of(text: Column) -> Column:
    """Words and runs of punctuation, lower-case."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(PUNCTUATION), F.lit(" $0 "))
    return F.filter(F.split(spaced, SPACE, -1), lambda t: t != "")


def marks_of(hashes: Column) -> Column:
    """The distinct hashes of a text's tokens, and two more: of the share of tokens that
    are distinct, in eighths, and of the magnitude of their number."""

    def with_shape(distinct: Column) -> Column:
        n = F.size(hashes)
        share = F.floor(F.size(distinct) * 8 / F.greatest(n, F.lit(1)))
        return F.concat(distinct, F.array(F.xxhash64(F.lit("\x00distinct"), share), F.xxhash64(F.lit("\x00number"), F.floor(F.log2(n + F.lit(1))))))

    return bound(F.array_distinct(hashes), with_shape)


class Model:
    """Evidence for each domain but the first, against the first.

    known: the hash of the token at each place (0: none); odds: by domain, the log odds at
    each place; prior: by domain, of any text.  shares: memberships of each cell, by
    domain (set by calibration).
    """

    def __init__(self, domains: list[str], places: int, prior: list[float] | None = None):
        self.domains, self.places = domains, places
        self.known = [0] * places
        self.odds = [[0.0] * places for _ in domains[1:]]
        self.prior = prior or [0.0] * (len(domains) - 1)
        self.shares = [[1 / len(domains)] * len(domains) for _ in range(len(domains) * LEVELS)]

    def cell(self, marks: Column) -> Column:
        """Number of the likeliest domain times LEVELS, and the level of its margin."""
        known, odds = constant(self.known, "bigint"), [constant(o, "double") for o in self.odds]
        at = lambda h: F.pmod(h, F.lit(self.places)).cast("int")
        hits = F.filter(marks, lambda h: F.get(known, at(h)) == h)

        def told(hits: Column, prior: float, odds: Column) -> Column:
            return F.aggregate(hits, F.lit(prior), lambda total, h: total + F.get(odds, at(h)))

        def judged(hits: Column) -> Column:
            evidence = F.array(F.lit(0.0), *(told(hits, p, o) for p, o in zip(self.prior, odds)))
            return bound(evidence, lambda e: placed(e, F.array_sort(e)))

        def placed(e: Column, ordered: Column) -> Column:
            n = len(self.domains)
            margin = bound(ordered, lambda s: F.get(s, F.lit(n - 1)) - F.get(s, F.lit(max(0, n - 2))))
            level = F.least(F.lit(LEVELS - 1), F.floor(margin * FINE).cast("int"))
            return (F.array_position(e, F.array_max(e)).cast("int") - 1) * LEVELS + level

        return bound(hits, judged)


def constant(numbers: list, kind: str) -> Column:
    """One constant array in the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], places: int = PLACES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A calibrated model.

    labelled has id_col and domain.  Of its rows with a known domain and an id, those of
    lowest hash of the id are the sample, as many of each domain at most, and count in
    proportion to all of the domain's; an id with several domains counts for the first in
    order.  Equal texts of a domain count once.  Without any example all domains are alike.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    known = labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    known = scratch.table(known, "known")
    whole = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    each = [known.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(max(1, sample // len(domains))) for d in domains]
    chosen = each[0]
    for more in each[1:]:
        chosen = chosen.unionByName(more)  # so many rows at most
    joined = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    distinct = joined.groupBy("domain", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))
    marks = marks_of(F.transform(tokens_of(F.col("text")), lambda t: F.xxhash64(t)))
    texts = scratch.table(distinct.select("domain", F.pmod("key", F.lit(PARTS)).alias("part"), marks.alias("marks")), "texts")
    n = {(r.domain, r.part): r["count"] for r in texts.groupBy("domain", "part").count().collect()}
    if not n:
        return Model(domains, places)
    tokens = texts.select("domain", "part", F.explode("marks").alias("h"))
    by = [F.sum(((F.col("domain") == d) & (F.col("part") == f)).cast("long")).alias(f"n{k}_{f}") for k, d in enumerate(domains) for f in range(PARTS)]
    counted = scratch.table(tokens.groupBy("h").agg(F.count("*").alias("n"), *by).where(F.col("n") >= LEAST_DOCS), "counted")
    # labelled documents that each one of the sample stands for
    sampled = {d: sum(n.get((d, f), 0) for f in range(PARTS)) for d in domains}
    weight = {d: whole.get(d, 0) / sampled[d] if sampled[d] else 0.0 for d in domains}
    model = _bayes(counted, n, weight, domains, places, list(range(PARTS)))
    judges = [_bayes(counted, n, weight, domains, places, [g for g in range(PARTS) if g != f]) for f in range(PARTS)]
    cell = F.coalesce(*(F.when(F.col("part") == f, judge.cell(F.col("marks"))) for f, judge in enumerate(judges)))
    found: dict[tuple[int, str], float] = {}
    for r in texts.groupBy("domain", cell.alias("cell")).count().collect():
        found[r.cell, r.domain] = found.get((r.cell, r.domain), 0.0) + r["count"] * weight[r.domain]
    # neighbouring levels count by half for each step between, all of the domain's a little,
    # and half a document of the whole's shares
    total = sum(whole.values())
    for cell in range(len(model.shares)):
        own = [0.5 * whole.get(d, 0) / total for d in domains]
        for near in range(cell // LEVELS * LEVELS, (cell // LEVELS + 1) * LEVELS):
            for k, d in enumerate(domains):
                own[k] += found.get((near, d), 0.0) * (0.5 ** abs(near - cell) + FAR)
        model.shares[cell] = [x / sum(own) for x in own]
    return model


def _bayes(counted: DataFrame, n: dict, weight: dict, domains: list[str], places: int, parts: list[int]) -> Model:
    """Naive Bayes on these parts of the sample, over numbers of documents."""
    model, sizes = Model(domains, places), [sum(n.get((d, f), 0) for f in parts) for d in domains]
    prior = [math.log(size * weight[d] + 0.5) for size, d in zip(sizes, domains)]
    model.prior = [round(p - prior[0], 6) for p in prior[1:]]
    own = [sum((F.col(f"n{k}_{f}") for f in parts), F.lit(0)) for k in range(len(domains))]
    telling, clearest = {}, []
    for k in range(1, len(domains)):
        if not sizes[k] or not sizes[0]:
            continue
        here, there = own[k] + 0.5, own[0] + 0.5
        odds = F.log(here / (sizes[k] + 1)) - F.log(there / (sizes[0] + 1))
        # root of the likelihood ratio against the same share in both domains
        part = sizes[k] / (sizes[k] + sizes[0])
        clear = F.sqrt(F.greatest(F.lit(0.0), 2 * (here * F.log(here / ((here + there) * part)) + there * F.log(there / ((here + there) * (1 - part))))))
        telling[f"o{k}"] = F.when((F.abs(odds) >= STRONG) & (clear >= CLEAR), F.round(odds, 4)).otherwise(0.0)
        clearest.append(F.when(telling[f"o{k}"] != 0, clear).otherwise(0.0))
    if not telling:
        return model
    # at most half the places: the clearest tokens; of two at one place the clearer stays
    best = counted.withColumns(telling | {"clear": F.greatest(F.lit(0.0), *clearest)}).where("clear > 0").orderBy(F.desc("clear"), "h").limit(places // 2).collect()
    # a smaller table where few tokens tell anything
    while len(best) * 4 < places > 256:
        places //= 2
    model = Model(domains, places, model.prior)
    for r in best:
        at = r.h % places
        if not model.known[at] and r.h:
            model.known[at] = r.h
            for name in telling:
                model.odds[int(name[1:]) - 1][at] = r[name]
    return model


def fit_rates(tokens: list[int], shares: list[list[float]], targets: list[float], ridge: float = RIDGE, still: float = STILL, most: int = STEPS) -> tuple[list[float], list[float]]:
    """Rates of cells with so many tokens and such memberships, and the expected share of
    each domain: the nonnegative least-squares fit to the targets, with the ridge, from rate one,
    at which a cell without tokens stays."""
    whole, rates, domains = sum(tokens), [1.0] * len(tokens), range(len(targets))
    there = [c for c, n in enumerate(tokens) if n]
    cells = [(tokens[c] / whole, shares[c]) for c in there]
    now = [1.0] * len(cells)
    total = lambda: [sum(p * r * s[k] for (p, s), r in zip(cells, now)) for k in domains]
    expected = total()
    for _ in range(most):
        excess = [x - t for x, t in zip(expected, targets)]
        now = [max(0.0, r - (sum(excess[k] * s[k] for k in domains) + ridge * (r - 1)) / (1 + ridge)) for (_, s), r in zip(cells, now)]
        before, expected = expected, total()
        if max(abs(x - y) for x, y in zip(before, expected)) < still:
            break
    for c, r in zip(there, now):
        rates[c] = r
    return rates, expected


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", prefix: str = "mix_", columns: list[str] | None = None, **fitting) -> DataFrame:
    """The columns of docs (or those named) with, each after the prefix: tokens, a
    membership for each domain, rate, copies (the rate rounded down or up by a hash of the
    row, so that the expected number of copies is the rate) and reached (whether the
    expected share of tokens of every domain is within NEAR of its target).

    targets: weight of each domain, by name; the mixture has as many tokens as docs.  Where
    targets are out of reach the rates are the least-squares optimum, and reached is false.
    Null and empty texts have no tokens; repeated rows have equal rates and copies.  A null
    id is hashed like any value.  Columns of docs that have a new column's name are replaced.
    """
    domains, weight = sorted(targets), sum(targets.values())
    scratch = Scratch(docs.sparkSession, "mixture")
    model = fit(docs, labelled, domains, id_col=id_col, text_col=text_col, **fitting)
    new = [f"{prefix}{c}" for c in ("tokens", *domains, "rate", "copies", "reached")]
    carried = {c: f"c{i}" for i, c in enumerate(docs.columns if columns is None else columns) if c not in new}
    hashes = F.transform(tokens_of(F.col(f"`{text_col}`")), lambda t: F.xxhash64(t))
    draw = F.pmod(F.xxhash64(F.lit("copies"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 30)) / float(1 << 30)
    judged = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in carried.items()), draw.alias("draw"), hashes.alias("hashes"))
    judged = judged.withColumn("marks", marks_of(F.col("hashes"))).select(*carried.values(), "draw", F.size("hashes").alias("tokens"), model.cell(F.col("marks")).alias("cell"))
    # written once: for the sums by cell, and for the result
    marked = scratch.table(judged, "marked")
    sums = {r.cell: r.tokens for r in marked.groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()}
    cells = range(len(model.shares))
    rates, expected = fit_rates([sums.get(c, 0) for c in cells], model.shares, [targets[d] / weight for d in domains])
    reached = all(abs(x - targets[d] / weight) <= NEAR for x, d in zip(expected, domains))
    of = lambda values: F.get(constant([round(x, 9) for x in values], "double"), F.col("cell"))
    rated = marked.withColumn("rate", of(rates))
    return rated.select(
        *(F.col(x).alias(c) for c, x in carried.items()),
        F.col("tokens").cast("long").alias(f"{prefix}tokens"),
        *(of([s[k] for s in model.shares]).alias(f"{prefix}{d}") for k, d in enumerate(domains)),
        F.col("rate").alias(f"{prefix}rate"),
        F.floor(F.col("rate") + F.col("draw")).cast("int").alias(f"{prefix}copies"),
        F.lit(reached).alias(f"{prefix}reached"),
    )
