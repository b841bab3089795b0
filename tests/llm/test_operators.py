"""Operators of the training-data part against plain versions on small tables."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signweave.llm import blocks, licenses, lines, mixing, packing, passages, quality, search, simhash, slices, tokens, vectors
from signweave.llm.license_rules import rules

SPACES = r"[^\x20\x09-\x0D]+"


def texts():
    """Nulls, empty and long texts, repeats, near copies, shared passages, odd characters."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices(["th", "er", "on", "an", "é", "re", "Ü", "st"], k=draw.randint(1, 4)))
    many = lambda n: " ".join(word() for _ in range(n))
    passage, line = many(60), "Posted by the " + many(6) + " team."
    found = [None, "", "  \n ", "a", "one two three", many(9000), passage, passage]
    for i in range(24):
        body = many(draw.randint(20, 200))
        found.append(f"{body}\n{line}\n{passage if i % 3 == 0 else ''} {many(30)}")
    near = many(1500).split()
    for i in range(6):
        copy = list(near)
        copy[i * 7] = "changed"
        found.append(" ".join(copy))
    found += ["x <|endoftext|> y", "日本語 テスト 👍🏽　z", "two  spaces\t\ttabs\r\n12345 don't I'LL", "\x1ca \xa0b\x85c", found[9], found[10]]
    # longer than a slice, so that it is one by itself
    found.append(many(230_000))
    assert len(found[-1].encode()) > slices.SLICE
    return found


@pytest.fixture(scope="module")
def bodies():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, bodies):
    """Columns that clash with the operators' own, a null id, and a repeated row."""
    names = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, key long, score double, n_words long"
    rows = [(i, t, "en", "src0", len(t or ""), -1, 7, 7, 2.0, 5) for i, t in enumerate(bodies)]
    rows += [rows[9], (None, bodies[12], "en", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, names).repartition(5).cache()


@pytest.fixture(scope="module")
def vecs(spark):
    draw = np.random.default_rng(3)
    rows, base = [], draw.standard_normal((30, 16))
    for i in range(200):
        x = base[i % 30] + 0.02 * draw.standard_normal(16) * (i % 4)
        rows.append((i, (x / np.linalg.norm(x)).tolist(), None if i % 17 == 5 else i % 3))
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(60)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0, None], 1), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (310, [float("inf")] + [0.0] * 15, 1), (None, rows[3][1], 0)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string")


def by_id(df, name="doc_id"):
    found = collections.defaultdict(list)
    for r in df.collect():
        found[r[name]].append(r)
    return found


def test_vocabulary_entries_reach_themselves():
    from signweave.llm.bpe import Bpe

    bpe, odd = Bpe(public_tokenizers.path("byte_bpe_50k.json")), 0
    for token, rank in bpe.ranks.items():
        text = bpe.library.id_to_token(rank)
        odd += [t.id for t in bpe.library.model.tokenize(text)] != [rank]
    assert odd == 0


def test_token_counts(docs, bodies):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(tokens.token_counts(docs, path, 100))
    for i, t in enumerate(bodies):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in got[i]} == {(len((t or "").encode()), n, n > 100)}
    assert len(got[9]) == 2 and len(got[None]) == 1


def test_both_tiers_count_alike(bodies):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in bodies]
    some = tokens.Lookup(path, tokens.frequent([t for t in bodies[:12] if t], path, 1 << 8, 100))
    assert some(bodies).tolist() == want and some.hits > 1000 and some.misses > 1000
    none = tokens.Lookup(path, tokens.frequent([], path))
    assert none(bodies).tolist() == want and not none.hits
    whole = tokens.Lookup(path, tokens.frequent([t for t in bodies if t], path))
    assert whole(bodies).tolist() == want and whole.hits > 10 * whole.misses


def test_cache_keeps_its_bound():
    from signweave.llm.bpe import Cache

    cache = Cache(len, 10)
    assert [cache[str(i) * 3] for i in range(100)] == [3 * len(str(i)) for i in range(100)]
    assert len(cache) <= 10 and len(cache.old) <= 10


@pytest.mark.parametrize("room,group", [(64, 7), (4096, 8192)])
def test_packing_is_whole_and_tight(docs, bodies, room, group):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, 2, room, group).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(bodies):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= room


def test_first_fit_decreasing_equals_a_plain_one():
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        k = next((k for k, x in enumerate(used) if x + lengths[i] <= 100), len(used))
        if k == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (k, used[k])
        used[k] += int(lengths[i])


def test_license_rules_are_many_and_compile():
    assert len(rules()) >= 200
    for _, _, confidence, keyword, pattern in rules():
        assert 0 < confidence <= 1 and keyword and re.compile(pattern)


def test_license_scan(spark, docs):
    cases = {
        0: ("Licensed under the MIT License. mit license", 6 + 1, [3, 5], "mit", {"mit"}),
        1: ("GNU General Public License, version 3 apache LICENSE", 8, [1, 6], "apache,gpl", {"gpl-3.0"}),
        2: ("general public  licenses; mitlicense mité license", 6, [], "", set()),
        3: (None, 0, [], "", set()),
        4: ("", 0, [], "", set()),
        5: ("SPDX-License-Identifier: Apache-2.0 and all rights reserved", 10, [], "", {"apache-2.0", "all-rights-reserved"}),
        6: ("Released under CC BY-NC 4.0.", 7, [], "", {"cc-by-nc"}),
        7: ("mit license " * 500, 1000, list(range(0, 1000, 2)), "mit", set()),
    }
    table = spark.createDataFrame([(i, c[0], "clash") for i, c in cases.items()], "doc_id int, text string, labels string")
    for i, (r,) in by_id(licenses.scan(table)).items():
        _, n, places, base, own = cases[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), base), i
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert set(filter(None, base.split(","))) | own <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and list(r.labels.split(",")) == sorted(r.labels.split(","))
    # a plain notice is one detection: the weaker ones inside it are suppressed
    (r,) = by_id(licenses.scan(table))[6]
    assert len(r.detections) == 1 and r.detections[0].label == "cc-by-nc"
    assert licenses.scan(docs).count() == docs.count()


def example(tree, draw):
    """A text that a parsed pattern matches."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "ANY":
            out += "q"
        elif op == "IN":
            kind, x = draw.choice(value)
            out += chr(x if str(kind) == "LITERAL" else draw.randint(*x))
        elif op == "BRANCH":
            out += example(draw.choice(value[1]), draw)
        elif op == "SUBPATTERN":
            out += example(value[3], draw)
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
            out += "".join(example(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], value[0] + 1))))
    return out


def test_license_gates_close_on_no_match(spark, monkeypatch):
    from re import _parser

    draw = random.Random(8)
    found = [example(_parser.parse(r[4]), draw) for r in rules() for _ in range(4)]
    assert all(re.fullmatch(r[4], found[4 * i + k]) for i, r in enumerate(rules()) for k in range(4))
    found += ["released under mit", "available under the apache 2 0", "https www mozilla org mpl 2 0", "agpl 3 0", "gpl v2 or later"]
    rows = [(n, sep.join(x.split(" ")).upper()) for n, (x, sep) in enumerate((x, sep) for x in found for sep in (" ", "\n", "\t", "-"))]
    table = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    gated = {r.doc_id: r for r in licenses.scan(table).collect()}
    every = [(*r[:3], " ", r[4]) for r in rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    monkeypatch.setattr(licenses, "may_match", lambda joined: F.lit(True))
    ungated = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert [x for n, x in rows if gated[n] != ungated[n]] == []
    assert [x for n, x in rows if not ungated[n].detections] == []


def plain_scan(text, compiled):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined, found = f" {' '.join(words)} ", []
    for i, (label, priority, confidence, rx) in enumerate(compiled):
        for m in rx.finditer(joined):
            first = joined[1 : m.start()].count(" ")
            found.append((first, first + m[0].count(" "), priority, i, label, confidence))
    inside = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2], e[1] - e[0], -e[3]) > (d[2], d[1] - d[0], -d[3])
    kept = [d for d in found if not any(inside(d, e) for e in found)]
    base = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    places, labels = [k for k, _ in base], {x for _, x in base}
    return (
        (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), max((d[5] for d in kept), default=0.0)),
        sorted((d[4], d[2], d[0], d[1]) for d in kept),
    )


def test_license_scan_equals_a_plain_engine(spark, bodies):
    compiled = [(*r[:3], re.compile(f"(?<= )(?:{r[4]})(?= )")) for r in rules()]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    notice = "Licensed under the Apache License, Version 2.0; see the LICENSE file. GNU GPL v2 or later. Copyright (c) 2001"
    odd = [*bodies, notice, notice, notice * 40, "all rights reserved " * 300, "MIT LICENSE mit-license mit\tlicense", "spdx-license-identifier: gpl-2.0 only"]
    whole = table.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    some = 0
    for r, text in ((r, r.text) for r in licenses.scan(whole).join(whole, "doc_id").collect()):
        want, detections = plain_scan(text, compiled)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want
        assert sorted((d.label, d.priority, d.first_word, d.last_word) for d in r.detections) == detections
        some += len(detections)
    assert some > 100


def test_license_repeats_take_no_square(spark):
    (r,) = licenses.scan(spark.createDataFrame([(1, "mit license " * 20_000)], "doc_id int, text string")).collect()
    assert r.n_base == 20_000 and len(r.detections) == 20_000


def test_substring_dedup(docs, bodies):
    words = {i: re.findall(SPACES, t or "") for i, t in enumerate(bodies)}
    least = {}
    for i, w in sorted(words.items()):
        for s in range(len(w) - 12):
            least.setdefault(tuple(w[s : s + 13]), i)
    got = by_id(passages.remove_repeats(docs, 13))
    some = 0
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if least[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert {(r.n_words, r.n_removed, r.kept) for r in got[i]} == {(len(w), sum(gone), kept)}
        some += sum(gone)
    assert some > 500 and got[None][0].n_removed == 0


def test_substring_dedup_doubles_through_several_levels(spark):
    assert passages.levels(13) == [7, 13] and passages.levels(50) == [7, 13, 25, 50]
    draw = random.Random(9)
    many = lambda n: [draw.choice("abcdefghijklmnop") + str(draw.randint(0, 40)) for _ in range(n)]
    hot, shared = many(60), [many(70) for _ in range(5)]
    words = [many(draw.randint(0, 80)) + (hot if i % 3 else many(9)) + shared[i % 5][: draw.randint(5, 70)] + many(20) for i in range(300)]
    words += [["x"] * n for n in (49, 50, 51, 200, 300)] + [words[3], words[4][:60]]
    least, length = {}, 50
    for i, w in enumerate(words):
        for s in range(len(w) - length + 1):
            least.setdefault(tuple(w[s : s + length]), i)
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(7, " ".join(words[8]))]
    got = by_id(passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id != 8"), length))
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            first = least[tuple(w[s : s + length])]
            if (7 if first == 8 else first) < i:
                gone[s : s + length] = [True] * length
        if i != 8:
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            assert (len(w), sum(gone), kept) in {(r.n_words, r.n_removed, r.kept) for r in got[i]}, i
            assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_removed for r in got[i])
    assert len(got[7]) == 2 and sum(r.n_removed > 0 for rs in got.values() for r in rs) > 100


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(vecs, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(vectors, "grouped", lambda e, s: blocks.grouped(e, s, block=block))
    rows = vecs.collect()
    fine = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links, count = [], collections.Counter()
    extra = [r for r in rows if r.vec_id is None]
    for a in fine + extra:
        for b in fine + extra:
            if a is not b and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    count[a.vec_id] += 1
                    if a.vec_id is not None and b.vec_id is not None:
                        links.append((a.vec_id, b.vec_id))
    want = components([r.vec_id for r in rows if r.vec_id is not None], links)
    got = vectors.near_vectors(vecs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == count[r.vec_id]
        if r.vec_id is not None:
            assert r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_near_vectors_recall(spark):
    """Planted pairs just above the threshold, among 50,000 vectors."""
    draw = np.random.default_rng(6)
    base = draw.standard_normal((49_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = draw.standard_normal((1000, 32))
    side -= (side * base[:1000]).sum(axis=1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    pairs = 0.981 * base[:1000] + np.sqrt(1 - 0.981**2) * side
    whole = np.concatenate([base, pairs])
    lists = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), 32).cast(pa.list_(pa.float64()))
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "label": pa.array(np.ones(50_000, np.int32)), "embedding": lists}))
    got = vectors.near_vectors(table.repartition(4)).where("n_links > 0").toPandas()
    found = set(got.vec_id[got.vec_id >= 49_000] - 49_000)
    assert len(found) >= 990 and (got.component_id <= got.vec_id).all()


@pytest.mark.parametrize("size", [(32768, 256), (16, 2)])
def test_top_k(vecs, size):
    rows = [r for r in vecs.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    whole = {r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding] for r in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.top_k(vecs, every=50, rows=size[0], queries=size[1]).collect()}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert [got.pop((q, k + 1)) for k in range(len(best))] == [(i, -s) for s, i in best]
    assert not got


def test_bit_slices_hold_the_top_rows():
    draw = np.random.default_rng(0)
    for spread in (3, 40, 256, 100_000):
        data = draw.integers(-spread, spread, (777, 12))
        index = search.Index(np.arange(777), data)
        for query in draw.integers(-spread, spread, (20, 12)):
            scores = data @ query
            near = index.near_top(query, 5)
            assert set(np.lexsort((np.arange(777), -scores))[:5]) <= set(near)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got[got.quality == 1].predicted.mean() > 0.99
    scores, y = got.score.to_numpy(), got.quality.to_numpy()
    rank = np.empty(len(scores))
    rank[np.argsort(scores)] = np.arange(len(scores))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.98


def test_quality_odd_rows(spark, docs, bodies):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None), (None, 1)], "doc_id long, quality int")
    got = by_id(quality.quality(docs, labels))
    for i in range(len(bodies)):
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got[i])
    assert got[0][0].score == got[1][0].score and len(got[9]) == 2
    none = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} and len(none) == docs.count()


def test_quality_workers_hold_little(spark, docs, monkeypatch):
    """What Python arrays take beside texts of 8 MB, in training and in scoring; a kept text is sent once."""
    sent, kind = [], type(docs)
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (sent.append((f, self.columns)), through(self, f, *a, **b))[1])
    model = quality.fit(docs, spark.createDataFrame([(9, 1), (12, 0)], "doc_id long, quality int"), lambda c: c >= 0, "quality", epochs=1)
    quality.scores(docs, model, ["doc_id", "text"])
    (learn, _), (score, columns) = sent
    assert columns == ["doc_id", "text"]
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(20_000)]
    bodies = [" ".join(draw.choices(words, k=600)) for _ in range(2000)]
    batch = pa.table({"id": range(2000), "doc_id": range(2000), "y": [i % 2 for i in range(2000)], "text": bodies}).combine_chunks().to_batches()[0]

    def most(f):
        tracemalloc.start()
        rows = sum(x.num_rows for x in f(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        return rows, peak

    learnt, scored = most(learn), most(score)
    assert learnt[0] == 1 and scored[0] == 2000
    assert learnt[1] < 110 and scored[1] < 40, (learnt, scored)


def test_quality_rows_as_they_were():
    draw = np.random.default_rng(4)
    found, rows = [], quality.Rows()
    for n in (0, 1, 7, 3000, 200_000):
        kinds = [np.concatenate([draw.integers(0, quality.BUCKETS, n), draw.integers(0, 9, n)]).astype(np.int32) for _ in range(4)]
        found.append(quality.shares(kinds))
        rows.add(*found[-1])
    assert len(rows) == len(found)
    for i, (ids, weights) in enumerate(found):
        assert np.array_equal(rows[i][0], ids) and np.array_equal(rows[i][1], weights) and rows[i][1].dtype == weights.dtype


def fingerprint(text):
    words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("block,hot", [(1024, 4096), (2, 4096), (1024, 2)])
def test_simhash(docs, bodies, block, hot, monkeypatch):
    monkeypatch.setattr(simhash, "grouped", lambda e, s, finer, hot: blocks.grouped(e, s, finer, block, hot))
    marks = {i: fingerprint(t) for i, t in enumerate(bodies)}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    want, got = components(marks, links), by_id(simhash.near_duplicates(docs, hot=hot))
    for i, mark in marks.items():
        assert {(r.fingerprint, r.component_id) for r in got[i]} == {(f"{mark:016x}", want[i])}
    assert got[None][0].component_id == want[12] and len(links) > 10


@pytest.mark.parametrize("spare", [2, 3, 4])
def test_close_fingerprints_share_a_table(spare):
    draw = random.Random(spare)
    masks = simhash.block_masks(4, spare)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
        assert any(a & m == b & m for m in simhash.finer_masks(simhash.finer_masks(masks, 4), 4))


def test_hot_bucket_is_split(spark, tmp_path):
    """One bucket of 20,000 fingerprints: few rows meet, and every close pair does."""
    draw = np.random.default_rng(4)
    fps = np.unique(draw.integers(0, 1 << 40, 20_000, dtype=np.uint64) << np.uint64(22) | np.uint64(0x155555))
    near = fps[:500] ^ (np.uint64(1) << draw.integers(22, 62, 500).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(22, 62, 500).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near])).view(np.int64)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(4)
    links = []
    for a in range(0, len(fps), 1000):
        i, j = np.nonzero(np.bitwise_count(fps[a : a + 1000, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= 4)
        links += [(int(fps[a + x]), int(fps[y])) for x, y in zip(i, j) if a + x < y]
    want = {i: c for i, c in components([int(x) for x in fps], links).items()}
    linked = {x for pair in links for x in pair}
    scratch, sent = simhash.Scratch(spark, "hot"), []
    plain = blocks.dealt
    blocks.dealt = lambda groups: sent.append(groups.count()) or plain(groups)
    try:
        got = {r.fp: r.component for r in simhash.components(table, 4, scratch).collect()}
    finally:
        blocks.dealt = plain
    assert got == {x: want[x] for x in linked} and len(links) >= 450
    # no more rows than the 15 tables have entries, though one bucket holds all of them
    assert sent[0] < 15 * len(fps)


@pytest.mark.parametrize("most", [lines.BROADCAST, 0])
def test_line_dedup(spark, most):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    rows = []
    for i in range(30):
        body = [" ".join(word() for _ in range(20)) for _ in range(4)]
        notice = f"Read the full story {word()} on page {i}" if i < 14 else "All pages are printed on paper" if i < 24 else "short line"
        rows.append((i, "\n".join([*body[:2], notice, *body[2:]])))
    copy = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
    rows += [(100 + i, copy) for i in range(20)] + [(200 + i, f"{copy} x{word()}") for i in range(20)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, rows[0][1]), rows[1]]
    table = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_dropped int")
    got = by_id(lines.drop_recurring_lines(table, broadcast=most))
    for i, text in rows[:30]:
        gone = i < 24
        assert all(r.n_dropped == int(gone) and r.n_lines == 5 for r in got[i]), i
        notice = text.split("\n")[2]
        assert (notice in got[i][0].text) != gone
    # copies are whole, for a near-duplicate stage; null and empty texts stay
    assert all(r.text == t and r.n_dropped == 0 for i, t in rows[30:70] for r in got[i])
    assert got[300][0].text is None and got[301][0].text == "" and got[302][0].text == "\n\n"
    assert got[None][0].n_dropped == 1 and len(got[1]) == 2
    assert got[0][0].asDict().keys() == {"doc_id", "text", "n_lines", "n_dropped"}


def test_line_dedup_of_texts_that_are_mostly_boilerplate(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    notice = "Subscribe to the weekly letter for all our news"
    rows = [(i, "\n".join([" ".join(word() for _ in range(6)), notice])) for i in range(40)]
    copy = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
    rows += [(100 + i, f"{copy} x{word()}") for i in range(20)]
    got = by_id(lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i][0].text == t.split("\n")[0] and got[i][0].n_dropped == 1 for i, t in rows[:40])
    # near copies are one document: their own lines do not recur
    assert all(got[i][0].text == t for i, t in rows[40:])


def test_mixing_meets_its_targets(spark):
    draw = random.Random(4)
    plain, odd = ["alpha", "beta", "gamma", "delta"], ["junk", "spam", "scam"]
    rows, labelled = [], []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, " ".join(draw.choices(plain, k=40) + (draw.choices(odd, k=5) if bad else [])), 1))
        if i % 2:
            labelled.append((i, "poor" if bad else "clean"))
    rows += [(None, rows[1][1], 1), rows[2], (700, None, 1), (701, "", 1)]
    # a user's columns of the names used inside stay; one of a new column's name is replaced
    docs = spark.createDataFrame([(*r, 5, 6.0, "x") for r in rows], "doc_id long, text string, tokens int, cell int, mix_rate double, hits string")
    table = spark.createDataFrame(labelled, "doc_id long, domain string")
    got = mixing.mix(docs, table, {"clean": 0.9, "poor": 0.1}).toPandas()
    assert list(got.columns) == ["doc_id", "text", "tokens", "cell", "hits", "mix_tokens", "mix_clean", "mix_poor", "mix_rate", "mix_copies", "mix_reached"]
    assert len(got) == len(rows) and ((got.mix_clean + got.mix_poor - 1).abs() < 1e-6).all() and got.mix_reached.all()
    assert set(got.tokens) == {1} and set(got.cell) == {5} and set(got.hits) == {"x"}
    total = got.mix_tokens.sum()
    for d, share in (("clean", 0.9), ("poor", 0.1)):
        assert abs((got.mix_tokens * got.mix_rate * got[f"mix_{d}"]).sum() / total - share) < mixing.NEAR
    assert (got.mix_rate >= 0).all() and ((got.mix_copies - got.mix_rate).abs() < 1).all()
    bad = got.doc_id % 3 == 0
    assert got[bad & (got.doc_id < 600)].mix_poor.min() > 0.5 > got[~bad & (got.doc_id < 600)].mix_poor.max()
    # no labels: even odds for all, and nothing fails
    assert mixing.mix(docs, table.limit(0), {"clean": 0.9, "poor": 0.1}).count() == len(rows)


def test_mixing_rates_are_optimal():
    draw = np.random.default_rng(8)
    for k in range(20):
        shares, tokens = draw.dirichlet([0.5] * 4, 30), draw.integers(0, 1000, 30)
        targets, part = draw.dirichlet([1.0] * 4), tokens / tokens.sum()
        rates, expected = mixing.fit_rates(tokens.tolist(), shares.tolist(), targets.tolist())
        r = np.array(rates)
        assert np.allclose((part * r) @ shares, expected) and (r >= 0).all() and (r[tokens == 0] == 1).all()
        slope = shares @ ((part * r) @ shares - targets) + mixing.RIDGE * (r - 1)
        there = tokens > 0
        assert (slope[there] > -1e-6).all() and (np.abs(slope[there & (r > 0)]) < 1e-6).all()


def plain_cell(model, text):
    words = re.sub(mixing.PUNCTUATION, lambda m: f" {m[0]} ", (text or "").lower())
    found = [t for t in re.split(mixing.SPACE, words) if t]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda n, seed: xxhash.xxh64_intdigest(int(n).to_bytes(8, "little"), seed)
    hashes = list(dict.fromkeys(signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in found))
    shape = [(b"\x00distinct", len(hashes) * 8 // max(1, len(found))), (b"\x00number", int(np.log2(len(found) + 1)))]
    marks = hashes + [signed(long(n, xxhash.xxh64_intdigest(x, 42))) for x, n in shape]
    hits = [h for h in marks if model.known[h % model.places] == h]
    told = [0.0]
    for prior, odds in zip(model.prior, model.odds):
        for h in hits:
            prior += odds[h % model.places]
        told.append(prior)
    best = sorted(told)
    return len(found), told.index(best[-1]) * mixing.LEVELS + min(mixing.LEVELS - 1, int((best[-1] - best[-2]) * mixing.FINE))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_equals_a_plain_version(spark, sf, monkeypatch):
    from signweave.llm.queries import DOMAIN, TARGETS

    fitted, fit = [], mixing.fit
    monkeypatch.setattr(mixing, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs.select("doc_id", "text"), labels.select("doc_id", F.expr(DOMAIN).alias("domain")), TARGETS).collect()
    model, domains, sums = fitted[0], sorted(TARGETS), collections.Counter()
    cells = {r.doc_id: plain_cell(model, r.text) for r in got}
    for n, cell in cells.values():
        sums[cell] += n
    rates, expected = mixing.fit_rates([sums[c] for c in range(len(model.shares))], model.shares, [TARGETS[d] for d in domains])
    for r in got:
        n, cell = cells[r.doc_id]
        assert r.mix_tokens == n and abs(r.mix_rate - rates[cell]) < 1e-6
        assert all(abs(r[f"mix_{d}"] - p) < 1e-6 for d, p in zip(domains, model.shares[cell]))
    total = sum(sums.values())
    off = [abs(sum(r.mix_tokens * r.mix_rate * r[f"mix_{d}"] for r in got) / total - TARGETS[d]) for d in domains]
    # the small table has too few labels: a tenth of its toxic ones look like any other text
    assert got[0].mix_reached == (max(off) <= mixing.NEAR) and (max(off) <= mixing.NEAR or sf == "sf0.01")
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert sum(r.mix_copies > 0 for r in got if r.doc_id in clean) >= 0.97 * len(clean)


def test_empty_tables(spark, docs, vecs):
    none, path = docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.token_counts(none, path, 5).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 2, 64).count() == 0
    assert licenses.scan(none).count() == 0
    assert passages.remove_repeats(none).count() == 0
    assert vectors.near_vectors(vecs.limit(0)).count() == 0
    assert search.top_k(vecs.limit(0)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(none, labels).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert lines.drop_recurring_lines(none).count() == 0
    assert mixing.mix(none, labels.select("doc_id", F.lit("a").alias("domain")), {"a": 1.0, "b": 1.0}).count() == 0


def test_kept_digest_of_query(spark):
    from signweave.llm.queries import op4_substring_dedup

    r = op4_substring_dedup(spark, "/root/testdata/sf0.001").where("n_removed = 0 and n_words > 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(re.findall(SPACES, text)).encode()).hexdigest()
