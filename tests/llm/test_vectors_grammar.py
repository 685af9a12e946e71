"""Hard negatives, whitening and Re-Pair files on small tables, against brute force."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsift.llm import negatives, repair, tokens, whitening
from poolsift.llm.common import table
from poolsift.session import shared_path

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")


# -------------------------------------------------------- hard negatives

def plain_negatives(rows, anchor, positives=5, negs=10, low=30, high=90):
    ends = -(1 << 63), (1 << 63) - 1
    own = [(i, l, [min(max(math.floor(256 * float(a)) if abs(a) < 1e300 else int(math.copysign(1 << 63, a)), ends[0]), 1 << 63) for a in v])
           for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, l, x) in enumerate(own):
        if i is None or not anchor(i):
            continue
        scored = [(min(max(sum(p * q for p, q in zip(x, y)), ends[0]), ends[1]), j, m) for b, (j, m, y) in enumerate(own)
                  if b != a and len(y) == len(x)]
        scored.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        for ps, p, _ in [t for t in scored if t[2] == l][:positives]:
            good = [t for t in scored if t[2] != l and low * ps <= 100 * t[0] <= high * ps][:negs]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j, _) in enumerate(good)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_BYTES", 8 * 8 * 60)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 40 * 25)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.4, (6, 8))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rng.normal(0, 0.15, 8)
        rows.append((int(i), int(rng.integers(0, 4)), [float(c) for c in v.astype(np.float32)]))
    hot = rows[20][2]
    rows += [(1000 + i, i % 3, hot) for i in range(250)]                        # ties beyond number
    rows += [(20, rows[20][1], hot)] * 3 + [(30, 2, hot), (None, 1, hot), (None, 1, hot)]        # repeated and null ids
    rows += [(2000, None, hot), (2010, 1, None), (2020, 1, [0.1, None] + [0.0] * 6), (2030, 1, [NAN] * 8), (2040, 0, [INF] + [0.0] * 7),
             (2050, 1, [0.0] * 8), (2060, 1, [0.5, 0.5]), (2070, 1, [0.6, 0.6]), (2080, 2, [0.3, 0.3]), (2090, 3, []), (2100, 3, []), (2110, 2, [])]
    df = spark.createDataFrame([(i, l, v, "x") for i, l, v in rows], "vec_id long, label int, embedding array<double>, rank string").repartition(5)
    df = df.checkpoint()
    got = [tuple(r) for r in negatives.mine(df, F.col("__id") % 10 == 0).collect()]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 2000 and ordered(got) == ordered(want)


def test_negatives_huge_components_and_few_rows(spark):
    rows = [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 2.0]), (2, 2, [5e8, 1e8]), (3, 2, [1e-3, 0.0]), (10, 3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = [tuple(r) for r in negatives.mine(df, F.col("__id") % 10 == 0).collect()]
    assert ordered(got) == ordered(plain_negatives(rows, lambda i: i % 10 == 0))
    assert negatives.mine(df.limit(0), F.col("__id") % 10 == 0).count() == 0
    assert negatives.mine(df.withColumn("label", F.lit(None).cast("int")), F.col("__id") >= 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.integers(1, 6))
def test_score_bounds_hold(seed, dim):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(0, rng.choice([1e-3, 0.3, 50.0]), (30, dim)))
    refs = rng.normal(size=(negatives.REFERENCES, dim))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    norm = np.linalg.norm(x, axis=1)
    angle = negatives.angles_to(x, norm, refs)
    lo, hi = negatives.score_bounds(angle, norm, angle, norm)
    s = x @ x.T
    assert (lo <= s).all() and (s <= hi).all()


def test_clustered_blocks_skip_shards(spark, monkeypatch):
    """Far clusters: blocks visit few of all shards."""
    monkeypatch.setattr(negatives, "SHARD_BYTES", 8 * 6 * 40)
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(c) for c in np.eye(6)[i % 6] + rng.normal(0, 0.01, 6)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").checkpoint()
    of = negatives.reference_directions(negatives.participants(df, "vec_id", "label", "embedding"), 256.0)
    packed = negatives._pack(negatives.participants(df, "vec_id", "label", "embedding").withColumn("__key", F.col("__id")), of, 256.0, 8, 1, lambda d: 40)
    asked = negatives._pack(negatives.participants(df, "vec_id", "label", "embedding").filter("__id % 10 = 0").withColumn("__key", F.col("__id"))
                            .withColumn("extra", F.array(F.lit(40000).cast("long"), F.lit(1 << 40).cast("long"))), of, 256.0, 8, 1, lambda d: 16, "extra")
    shards, blocks = packed.select("pack").distinct().count(), asked.select("pack").distinct().count()
    assert negatives.visits(packed.checkpoint(), asked.checkpoint()).count() < shards * blocks / 3


# ------------------------------------------------------------- whitening

def check_whitening(got, rows, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, d = x.shape
    s = x.sum(0)
    c = n * x - s
    v = (c.astype(float) / n).T @ (c.astype(float) / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k
    by = {(r.vec_id, r.component): r for r in got}
    dev = {i: sum(int(a) ** 2 for a in row) for (i, _), row in zip(rows, c)}
    w = np.array([[by[i, j + 1].whitened for j in range(k)] for i, _ in rows])
    for r in got:
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-9
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6 and 0 <= got[0].identity_error < 1e-4
    # apart from signs (and turns among equal eigenvalues) the same projections
    p = (c.astype(float) / n) @ u[:, :k] / np.sqrt(e[:k])
    single = [j for j in range(k) if all(abs(e[j] - e[i]) > 1e-6 * e[0] for i in range(d) if i != j)]
    for j in single:
        assert min(np.abs(p[:, j] - w[:, j]).max(), np.abs(p[:, j] + w[:, j]).max()) < 1e-5


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 1, (300, 40)) * np.geomspace(5, 0.02, 40)
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(m)]
    bad = [(900, None), (901, [1.0] * 39 + [None]), (902, [NAN] * 40), (903, [INF] * 40), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, component int")
    check_whitening(whitening.whiten(df).collect(), rows, 32)


def test_whitening_registered_table(spark):
    df = table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check_whitening(whitening.whiten(df).collect(), rows, 32)


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [NAN])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    # one direction only, repeated and null ids
    line = [(None if i == 3 else i % 5, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 20 and {r.component for r in got} == {1} and sum(r.vec_id is None for r in got) == 1
    assert abs(sum(r.whitened ** 2 for r in got) / 20 - 1) < 1e-9
    # beyond int64: deviations stay exact, or end at the end of a long
    big = whitening.whiten(spark.createDataFrame([(0, [1e9]), (1, [-1e9]), (2, [3e8])], schema)).collect()
    x = [math.floor(64 * v) + 1_000_000 for v in (1e9, -1e9, 3e8)]
    assert [r.deviation for r in sorted(big, key=lambda r: r.vec_id)] == [min((3 * a - sum(x)) ** 2, (1 << 63) - 1) for a in x]
    assert whitening.whiten(spark.createDataFrame([(0, [1e300]), (1, [-1e300])], schema)).count() == 2


@pytest.mark.parametrize("kind", ["random", "equal", "pairs", "steep", "block"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    e = {"random": rng.random(24), "equal": np.ones(24), "pairs": np.repeat(rng.random(12), 2), "steep": np.geomspace(1, 1e-8, 24),
         "block": np.array([3.0] * 5 + [3.0 - 1e-9] * 5 + [1.0] * 14)}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading_pairs(v, 16)
    assert np.allclose(values, np.sort(e)[::-1][:16], rtol=1e-7, atol=1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * max(1, e.max()) * 10
    inertia = whitening.Inertia(v)
    for shift in (0.5, 0.1, 2.0):
        assert inertia.above(shift) == int((np.linalg.eigvalsh(v) > shift).sum())


# --------------------------------------------------------------- Re-Pair

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(0, 5))
def test_shard_round_trip(ids, docs):
    ids = np.array(ids * 3, np.uint32)
    cuts = np.sort(np.random.default_rng(docs).integers(0, len(ids) + 1, docs))
    lengths = np.diff(np.concatenate([[0], cuts, [len(ids)]])).tolist()
    shard = repair.Shard(repair.to_bytes([None, *range(len(lengths) - 1)], lengths, ids))
    assert shard.doc_ids == [None, *range(len(lengths) - 1)] and np.array_equal(shard.tokens(), ids)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(lengths)):
        assert np.array_equal(shard.document(i), ids[at[i]:at[i + 1]])
    assert np.array_equal(shard.grammar.lengths(), shard.size)


def test_grammar_shrinks_repeats_and_runs():
    rng = np.random.default_rng(0)
    phrases = [rng.integers(0, 50_000, 30) for _ in range(20)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 20, 2000)]).astype(np.uint32)
    g = repair.compress(ids)
    assert len(g.sequence) + 2 * len(g.left) < len(ids) / 8 and np.array_equal(g.expand(g.sequence), ids)
    run = np.full(5000, 7, np.uint32)
    g = repair.compress(run)
    assert len(g.sequence) < 20 and np.array_equal(g.expand(g.sequence), run)
    # a pair that is left once and right once is never replaced twice in one place
    aba = np.tile(np.array([1, 2, 1, 2, 1, 3], np.uint32), 400)
    assert np.array_equal(repair.compress(aba).expand(repair.compress(aba).sequence), aba)


def plain_rounds(ids):
    """Rules and sequence of Re-Pair in rounds, symbol by symbol."""
    terminals = sorted(set(ids.tolist()))
    seq, rules, rounds = [terminals.index(i) for i in ids.tolist()], [], []
    while len(seq) > 1:
        counts = Counter(zip(seq[:-1], seq[1:]))
        role, slots = {}, {}
        for a, b in sorted((p for p, n in counts.items() if n >= repair.MIN_COUNT), key=lambda p: (-counts[p], p)):
            if a in role or b in role and a == b:
                fits = role.get(a) == 1 and a != b and role.get(b, 2) == 2
            else:
                fits = a == b or role.get(b, 2) == 2
            if fits:
                role.update({a: 3} if a == b else {a: 1, b: 2})
                slot = ((a * (len(terminals) + len(rules)) + b) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - repair.TABLE_BITS)
                slots.setdefault(slot, (a, b))
        if not role:
            break
        made = {p: len(terminals) + len(rules) + k for k, p in enumerate(slots.values())}
        rules += made
        rounds.append(len(rules))
        out, at = [], 0
        while at < len(seq):
            new = made.get(tuple(seq[at:at + 2]))
            out.append(seq[at] if new is None else new)
            at += 1 if new is None else 2
        gained = (len(seq) - len(out)) / len(seq)
        seq = out
        if gained < repair.LEAST_GAIN:
            break
    return rounds, rules, seq


@pytest.mark.parametrize("kind", ["few", "runs", "words", "tiled", "many", "one", "none"])
def test_grammar_equals_plain_rounds(kind):
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3000, rng.integers(1, 6)) for _ in range(2000)]
    ids = {"few": rng.integers(0, 5, 3000), "runs": np.repeat(rng.integers(0, 30, 3000), rng.integers(1, 9, 3000)),
           "words": np.concatenate([words[int(i) % 2000] for i in rng.zipf(1.3, 15_000)]), "tiled": np.tile(rng.integers(0, 900, 700), 20),
           "many": np.tile(rng.permutation(70_000), 4), "one": np.array([9]), "none": np.zeros(0)}[kind].astype(np.uint32)
    g = repair.compress(ids)
    rounds, rules, seq = plain_rounds(ids) if kind != "many" else (g.rounds.tolist(), list(zip(g.left.tolist(), g.right.tolist())), g.sequence.tolist())
    assert g.rounds.tolist() == rounds and list(zip(g.left.tolist(), g.right.tolist())) == rules and g.sequence.tolist() == seq
    assert np.array_equal(g.tokens(), ids) and np.array_equal(g.expand(g.sequence), ids)


def cpu(run, times=5):
    """CPU seconds of the fastest of some runs."""
    out = []
    for _ in range(times):
        at = time.process_time()
        run()
        out.append(time.process_time() - at)
    return min(out)


def test_whole_shards_decode_by_one_table():
    # opening round after round over the whole sequence took as long as expand does
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 3000, rng.integers(1, 6)) for _ in range(20_000)]
    ids = np.concatenate([words[int(i) % 20_000] for i in rng.zipf(1.2, 150_000)]).astype(np.uint32)
    shard = repair.Shard(repair.to_bytes([1], [len(ids)], ids))
    assert len(shard.grammar.rounds) > 3 and np.array_equal(shard.tokens(), ids)
    assert cpu(shard.tokens) < 0.6 * cpu(lambda: shard.grammar.expand(shard.grammar.sequence))


def test_long_runs_are_found():
    for before in (0, 1, 2047, 2048, 3001):
        assert tokens.long_run("a b" * before + " " + "x" * 4096 + " end") and not tokens.long_run("word " * before + "x" * 2000 + " end")


def plain_documents(rows):
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_repair_whole_table(spark):
    docs = table(spark, SF, "documents")
    path = shared_path(spark, "repair-test")
    repair.write_shards(docs, path, shard_tokens=20_000)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_documents(rows)
    assert ordered(tuple(r) for r in repair.read_documents(spark, path).collect()) == ordered(want)
    files = spark.read.parquet(path)
    stored = files.agg(F.sum(F.length("file")), F.sum("n_tokens")).first()
    assert files.count() > 10 and stored[0] < 2 * stored[1]          # below 16 bits a token
    some = [rows[i][0] for i in (0, 17, 400)]
    got = {r.doc_id: r.ids for r in repair.fetch_documents(spark, path, some + [-5]).collect()}
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    assert got == {i: [*tokenizer.encode(dict(rows)[i] or "", add_special_tokens=False).ids, 2] for i in some}
    assert repair.fetch_documents(spark, path, []).count() == 0


def test_repair_edge_cases(spark):
    rows = [(5, "one two"), (None, "x"), (3, None), (3, ""), (9, "word " * 60_000), (-4, "<|endoftext|> \n\n é"), (2, "a" * 9000), (None, None)]
    df = spark.createDataFrame([(i, t, 0, "f") for i, t in rows], "doc_id long, text string, start int, file string").repartition(3).checkpoint()
    path = shared_path(spark, "repair-test")
    repair.write_shards(df, path, shard_tokens=500)
    got = [tuple(r) for r in repair.read_documents(spark, path).collect()]
    want = plain_documents(rows)
    assert ordered((i, n, c) for i, _, n, c in got) == ordered((i, n, c) for i, _, n, c in want)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.concatenate([[0], np.cumsum([r[2] for r in by_start])])[:-1].tolist()
    assert [r[0] for r in by_start] == [None, None, -4, 2, 3, 3, 5, 9]
    # a third of all rows is one row
    same = spark.createDataFrame([(7, "same words")] * 300 + [(i, "other") for i in range(600)], "doc_id long, text string").checkpoint()
    path = shared_path(spark, "repair-test")
    repair.write_shards(same, path)
    got = sorted((tuple(r) for r in repair.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([7] * 300 + list(range(600))) and len({r[1] for r in got}) == 900
    path = shared_path(spark, "repair-test")
    repair.write_shards(df.limit(0), path)
    assert repair.read_documents(spark, path).count() == 0 and repair.fetch_documents(spark, path, [1]).count() == 0
