"""Language id, mixing, packing and top-k search on small tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsift.llm import language, mixing, packing, tokens, topk
from poolsift.llm.common import table

SF = "/root/testdata/sf0.01"


# -------------------------------------------------------------- language

def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = out.filter("held_out AND n > 20").collect()
    assert len(held) > 150 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edge_cases(spark):
    rows = [(i, t, l, 1) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "123 .,! ²", "fr", 1), (103, "the dog " * 50_000, None, 1), (None, "le chien", "fr", 1), (7, "le chat", "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __text int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und" and by[100].score == 0.0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out
    empty = docs.limit(0)
    assert language.identify(empty).count() == 0
    only = language.identify(docs.withColumn("lang", F.lit("en"))).filter("lang_pred <> 'und'").collect()
    assert {r.lang_pred for r in only} == {"en"}
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_counts_equal_a_plain_loop():
    text = "Été 3 über\n𐐀x 日本"
    got = language.count_ngrams(text)
    letters = [c if c.isalpha() else "\0" for c in text.lower()]
    assert got.sum() == 3 * sum(c != "\0" for c in letters)
    assert np.array_equal(got, language.count_ngrams(text.lower()))
    assert language.count_ngrams("12 3") is None and language.count_ngrams(None) is None


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_correct_errors(n):
    code = language.codewords(n)
    d = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
    assert d >= (1 if n == 2 else 2 if n == 3 else 3)
    assert ((code.sum(0) > 0) & (code.sum(0) < n)).all()


def plain_ngrams(text):
    """Hashed one- to three-letter n-grams, letter by letter; text ends and other characters count as 0."""
    p = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    full, shift = (1 << 32) - 1, 32 - (language.FEATURES.bit_length() - 1)
    out = defaultdict(int)
    for a, b, c in zip(p, p[1:], p[2:]):
        if b:
            out[(b * 2654435761 & full) >> shift] += 1
            out[((((a * 2246822519 + b) & full) * 3266489917 + 1) & full) >> shift] += 1
            out[((((((a * 668265263 + b) & full) * 374761393 + c) & full) * 2654435761 + 2) & full) >> shift] += 1
    return out


def test_language_equals_a_plain_training_and_decoding(spark):
    import math
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    counts = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            for f, n in plain_ngrams(text).items():
                counts.setdefault(lang, defaultdict(int))[f] += n
    langs = sorted(counts)
    # every way to split the languages into two sides, the first one always on side 0... of a binary number
    code = [[(m >> i) & 1 for m in range(1, 1 << (len(langs) - 1))] for i in range(len(langs))]
    bits = range(len(code[0]))
    share = [[(counts[x].get(f, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * language.FEATURES) for f in range(language.FEATURES)] for x in langs]
    side = [[[i for i in range(len(langs)) if code[i][b] == v] for v in (0, 1)] for b in bits]
    odds = [[math.log(sum(share[i][f] for i in side[b][1]) / len(side[b][1])) - math.log(sum(share[i][f] for i in side[b][0]) / len(side[b][0]))
             for f in range(language.FEATURES)] for b in bits]
    weight = [[max((1 if code[i][b] else -1) * sum(x * y for x, y in zip(share[i], odds[b])), 1e-6) for b in bits] for i in range(len(langs))]
    weight = [[w / sum(ws) for w in ws] for ws in weight]
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for i, text, _ in rows:
        seen = plain_ngrams(text)
        if not seen:
            assert got[i].lang_pred == "und"
            continue
        margin = [language.SHARPNESS * sum(n * odds[b][f] for f, n in seen.items()) / sum(seen.values()) for b in bits]
        loss = [sum(weight[x][b] * (math.log1p(math.exp(-abs(m))) + max(m, 0.0)) for b in bits
                    for m in [-(1 if code[x][b] else -1) * margin[b]]) for x in range(len(langs))]
        like = [math.exp(min(loss) - v) for v in loss]
        assert got[i].lang_pred == langs[loss.index(min(loss))] and abs(got[i].score - max(like) / sum(like)) < 1e-6


# ---------------------------------------------------------------- mixing

def test_registered_targets_with_the_floor_reach_the_least_loss(spark):
    """The floor of clean documents bounds what any rates reach; the steps come within a hundredth of all
    tokens of the least distance, which a plain projection finds in very many steps."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = mixing.document_rates(docs, labels).collect()
    p, t = np.array([r["__p"] for r in found]), np.array([r["__tokens"] for r in found], float)
    floor = (p[:, 0] >= p.max(1)).astype(float)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * (t @ p)

    def loss(w):
        return float((((t * w) @ p - want) ** 2).sum())

    got = np.array([r["__rate"] for r in found])
    assert (got >= floor - 1e-12).all()
    v, h = np.ones(len(t)), np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    for _ in range(20_000):
        v = np.maximum(floor, v - p @ ((t * v) @ p - want) / h)
    assert loss(got) ** 0.5 <= loss(v) ** 0.5 + 0.01 * t.sum()
    # the toxic share that the classifier sees inside documents that must stay is out of reach
    reached = (t * got) @ p / (t @ p)
    assert abs(reached[0] - 1.25) < 0.03 and abs(reached[1] - 0.5) < 0.05 and reached[2] < 0.5
    copies = np.array([r["__copies"] for r in found])
    assert (np.abs(copies - got) < 1).all()


def test_rates_reach_targets_and_equal_a_plain_projection(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 3000, 400)
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "__tokens long, __p array<double>")
    targets = {"clean": 1.25, "low": 0.5, "toxic": 0.2}
    steps, told = mixing.fit_rates(frame, targets, None)
    w = np.ones(400)
    for z in steps:
        w = np.maximum(0, w - p @ z)
    got = [r.w for r in frame.select(mixing.rate(F.col("__p"), F.lit(0.0), steps).alias("w")).collect()]
    assert np.allclose(sorted(got), sorted(w)) and min(got) >= 0
    want = np.array([targets[d] for d in mixing.DOMAINS]) * (t @ p)
    assert np.allclose((t * w) @ p, list(told["expected"].values()))
    assert np.abs((t * w) @ p - want).max() < 0.01 * t.sum()
    # plain projected gradient in the same metric comes to the same loss, which is nearly none
    v, h = np.ones(400), np.linalg.eigvalsh(p.T @ (p * t[:, None])).max()
    for _ in range(3000):
        v = np.maximum(0, v - p @ ((t * v) @ p - want) / h)
    assert np.abs((t * v) @ p - want).max() < 0.01 * t.sum()


def test_mixing_drops_toxic_and_keeps_clean(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = mixing.mix(docs, labels).join(labels.withColumn("domain", mixing.label_domain()).select("doc_id", "domain"), "doc_id").collect()
    by = defaultdict(list)
    for r in out:
        by[r.domain].append(r["__copies"])
    assert np.mean([c == 0 for c in by["toxic"]]) > 0.6
    assert np.mean([c >= 1 for c in by["clean"]]) > 0.97
    assert np.mean(by["low"]) < 0.8


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, __p int, __copies int, domain string"
    rows = [(i, "good words here again " + str(i), 1, 2, "x") for i in range(20)] + [(None, None, 1, 2, "x"), (5, "", 1, 2, "x"), (6, "w " * 200_000, 1, 2, "x"), (7, "...", 1, 2, "x")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    assert out.count() == len(rows)
    back = mixing.repeated(out)
    assert back.columns == ["doc_id", "text", "domain"] or set(back.columns) <= {f.split()[0] for f in schema.split(", ")}
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).count() == len(rows)


# --------------------------------------------------------------- packing

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_fits_and_is_near_equal(sizes):
    where = packing.pack(sizes, 64)
    assert len(where) == len(sizes)
    if sizes:
        load = np.bincount(where, sizes)
        assert load.max() <= 64 and (load > 0).all()


def test_differencing_beats_nothing_known():
    # the textbook case: 8 7 6 5 4 into two windows; differencing leaves 2
    load = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(load) == [14, 16]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, 900)
    load = np.bincount(packing.difference(sizes, 120), sizes)
    assert load.max() - load.min() < 60
    with pytest.raises(ValueError):
        packing.pack([65], 64)


def check_packing(rows, texts, encode, capacity):
    """Every id once, in gapless windows; digests of the very ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, rs in by_doc.items():
        ids = encode(texts[i] or "") + packing.END
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    pad = total = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        pad += capacity - at
        total += at
    return pad / max(total, 1)


def test_packing_whole_table(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    encoder = tokens.encoder(tokens.default_path())

    def plain(text):
        return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    assert check_packing(packing.pack_documents(docs).collect(), texts, plain, 2048) < 0.02


def test_packing_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x", 0), (4, "word " * 30_000, 0), (5, "a" * 9000, 0), (6, "<|endoftext|> \n\n  　x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack_documents(docs, capacity=256, piece=64).collect()
    encoder = tokens.encoder(tokens.default_path())
    check_packing(got, {r[0]: r[1] for r in rows}, lambda t: np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), 256)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(3, "one two")] * 2, "doc_id long, text string")).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizer(text):
    encoder = tokens.encoder(tokens.default_path())
    assert list(np.frombuffer(encoder.ids(text), "<u4")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# ----------------------------------------------------------------- top-k

def plain_topk(rows, k, queries):
    import math
    x = [(i, [math.floor(256 * float(a)) for a in v]) for i, v in rows
         if v is not None and all(a is not None and math.isfinite(a) for a in v)]
    out = []
    for at, (q, v) in enumerate(x):
        if q is not None and queries(q):
            best = sorted(((-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for other, (c, w) in enumerate(x)
                           if other != at and len(w) == len(v)))[:k]
            out += [(q, r + 1, None if null else c, -s) for r, (s, null, c) in enumerate(best)]
    return out


def by_rank(rows):
    return sorted(rows, key=lambda x: (x[0], x[1], -x[3], x[2] is None, x[2] or 0))


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in rng.permutation(900)]
    hot = rows[3][1]
    rows += [(i, hot) for i in range(1000, 1400)]                      # ties beyond number
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7),
             (None, hot), (2005, [0.5, 0.25]), (2010, [0.5, -0.25]), (2015, []), (2020, []), (7, [9.0] * 8), (2025, [1e12, -1e12] + [1.0] * 6), (2030, [3e9] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    rows += [(5, hot), (5, hot), (5, rows[7][1]), (None, hot)]           # repeated and null ids are rows of their own
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = by_rank(tuple(r) for r in topk.search(df, F.col("__id") % 5 == 0, 5).collect())
    low, high = -(1 << 63), (1 << 63) - 1
    want = by_rank((q, r, c, min(max(s, low), high)) for q, r, c, s in plain_topk(rows, 5, lambda i: i % 5 == 0))
    assert [x for x in got if x[0] < 2025] == [x for x in want if x[0] < 2025]
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]


def test_topk_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("__id") % 50 == 0, 5).collect()] == [(0, 1, 1, 3 * 65536)]
    assert topk.search(df.limit(0), F.col("__id") % 50 == 0, 5).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.score for r in topk.search(twice, F.col("__id") % 50 == 0, 5).orderBy("rank").collect()] == [196608, 131072, 65536]


def test_blocks_skip_shards_of_far_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in 3.0 * np.eye(8)[i % 8] + rng.normal(0, 0.02, 8)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    plain = topk.visits
    monkeypatch.setattr(topk, "visits", lambda r, b: met.append((r.count(), b.count(), plain(r, b).count())) or plain(r, b))
    got = by_rank(tuple(r) for r in topk.search(df, F.col("__id") % 10 == 0, 5).collect())
    assert got == by_rank(plain_topk(rows, 5, lambda i: i % 10 == 0))
    (shards, blocks, pairs), = met
    assert pairs < shards * blocks / 3


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.2, (700, 16)))
    tree = topk.BallTree(np.arange(700), x, np.arange(700))
    q = np.floor(256 * rng.normal(0, 0.2, (50, 16)))
    for c, r, _, rows, _ in tree.nodes:
        if rows is not None:
            assert ((q @ x[rows].T).max(1) <= q @ c + np.linalg.norm(q, axis=1) * r + 1e-6).all()
    s, w = tree.search(np.arange(1000, 1050), q, 5, np.full(50, topk.LOWEST), np.full(50, topk.NO_ID))
    assert np.array_equal(s, -np.sort(-(q @ x.T).astype(np.int64), axis=1)[:, :5])
