"""Every stage of the corpus pipeline against a plain version on the stage's own input."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_operators import bodies, components, docs, fingerprint  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from signweave.llm import lines, mixing, quality, slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        found.append(docs)
    return found


def plain_lines(texts):
    """Line dedup by definition, with everything in memory."""
    parsed = {t: [lines.parse(x.encode(), lines.DEPTH, lines.LONG) for x in t.split("\n")] for t in set(texts)}
    enough = lambda leaf: lines.LONG_DOCS if leaf & 1 else lines.DOCS
    held = collections.defaultdict(set)
    for t, rows in parsed.items():
        for tokens, leaf in rows:
            if len(tokens) >= lines.TOKENS:
                held[leaf].add(t)
    leaves = {leaf for leaf, ts in held.items() if len(ts) >= enough(leaf)}
    asked = {t for leaf in leaves for t in held[leaf]}
    marks = {t: fingerprint(t) for t in asked}
    distinct = sorted(set(marks.values()))
    near = components(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    line_texts, at_place = collections.defaultdict(set), collections.defaultdict(int)
    for t, rows in parsed.items():
        for tokens, leaf in rows:
            if len(tokens) >= lines.TOKENS and leaf in leaves:
                line_texts[leaf, tuple(tokens)].add(t)
    copies = lambda ts: {near[marks[t]] for t in ts}
    for (leaf, tokens), ts in line_texts.items():
        for place, token in enumerate(tokens):
            at_place[leaf, place, token] += len(copies(ts))
    template_texts, template_of = collections.defaultdict(set), {}
    for (leaf, tokens), ts in line_texts.items():
        shape = tuple(x if x != b"<*>" and at_place[leaf, i, x] >= enough(leaf) else b"<*>" for i, x in enumerate(tokens))
        if sum(x != b"<*>" for x in shape) >= lines.CONSTANT * len(shape):
            template_of[tokens] = (leaf, shape)
            template_texts[leaf, shape] |= ts

    def key(t):
        h = xxhash.xxh64_intdigest(b"text", xxhash.xxh64_intdigest(t.encode(), 42))
        return h - (1 << 64) if h >> 63 else h

    def goes(t, tokens):
        template = template_of.get(tuple(tokens))
        if template is None or len(copies(template_texts[template])) < enough(template[0]):
            return False
        return not (template[0] & 1 and key(t) == min(map(key, template_texts[template])))

    return ["\n".join(x for x, (tokens, _) in zip(t.split("\n"), parsed[t]) if not goes(t, tokens)) for t in texts]


def test_line_stage_on_a_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert [got[r.doc_id] for r in rows] == plain_lines([r.text for r in rows])


def test_stages_on_odd_rows(spark, docs, tmp_path):  # noqa: F811
    """Null ids and texts, empty and long texts, repeated rows, clashing columns, no rows."""
    odd = docs.drop("lang", "source").selectExpr("*", "cast(null as string) as lang", "'s' as source")
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        found = rows
        for stage_name, stage in corpus_pipeline.STAGES:
            stage(spark, found, SF).write.parquet(f"{tmp_path}/{name}-{stage_name}")
            found = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
            if stage_name != "packing":
                assert found.columns == corpus_pipeline.COLUMNS
            assert name == "odd" or found.count() == 0
        assert name == "none" or found.count() > 0


def test_schema(stages):
    for docs in stages[1:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS


def plain_score(text, weights, bias):
    """Score of a text by definition, with whole numbers of any size."""
    full = (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & full
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & full
        return x ^ x >> 33

    def span(x):
        return mix(sum((c + 1) * pow(int(slices.BASE), i, 1 << 64) for i, c in enumerate(x)) + len(x) * int(slices.LENGTH) & full)

    at = lambda h: weights[h & (quality.BUCKETS - 1)]
    words = [span(w) for w in text.encode().split()]
    pairs = [quality.SAME if a == b else mix(a * 0x9E3779B97F4A7C15 + b & full) for a, b in zip(words, words[1:])]
    kinds = [words, pairs] + [[mix(span(text[i : i + n].encode()) + n & full) for i in range(len(text) - n + 1)] for n in quality.GRAMS]
    odds = bias + sum(sum(float(at(h)) for h in kind) / (len(kinds) * max(1, len(kind))) for kind in kinds)
    return 1 / (1 + np.exp(-odds))


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = quality.fit(stages[0], labels, lambda c: quality.fold(c) != 0, "quality")
    want = {r.doc_id: plain_score(r.text or "", weights, bias) for r in stages[0].collect()}
    got = {r.doc_id: r.score for r in quality.scores(stages[0], (weights, bias), ["doc_id"]).collect()}
    assert all(abs(got[i] - x) < 1e-4 for i, x in want.items())
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(i for i, x in got.items() if x >= 0.3)


def test_line_stage(stages):
    before, after = (sorted(x.collect(), key=lambda r: r.doc_id) for x in stages[1:3])
    assert [r.text for r in after] == plain_lines([r.text for r in before])
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    assert all(r.n_chars == len(r.text) for r, b in zip(after, before) if r.text != b.text)


def test_near_duplicate_stage(stages):
    marks = {r.doc_id: fingerprint(r.text) for r in stages[2].collect()}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    want = components(marks, links)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in marks if want[i] == i)


def test_near_duplicate_stage_with_repeated_ids(spark):
    draw = random.Random(3)
    body = lambda: " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(3000))
    a, b, c, d, e = (body() for _ in range(5))
    # 2 is a near copy of 1 and a text of its own; 3 is two texts; 4 is one text twice and a near copy
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, d), (4, e), (4, e), (4, e + " end"), (None, a)]
    marks = [fingerprint(t) for _, t in rows]
    assert (marks[0] ^ marks[1]).bit_count() <= 4 and (marks[5] ^ marks[7]).bit_count() <= 4
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (2, b), (3, c), (3, d), (4, e), (None, a)]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)


def test_mixing_stage(spark, stages):
    from pyspark.sql import functions as F

    labelled = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.expr(corpus_pipeline.DOMAIN).alias("domain"))
    copies = {r.doc_id: r.mix_copies for r in mixing.mix(stages[3], labelled, corpus_pipeline.TARGETS).collect()}
    got = collections.Counter(r.doc_id for r in stages[4].collect())
    assert got == collections.Counter({i: n for i, n in copies.items() if n})


def test_packing_stage(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in stages[4].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 4096):
            want[r.doc_id, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    pieces = stages[5].collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces) == want
    room = collections.Counter()
    for r in pieces:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in stages[5].collect())
    assert corpus_pipeline.ORACLE_SQL is None
