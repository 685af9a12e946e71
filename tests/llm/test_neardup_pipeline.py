"""Near duplicates against all pairs, components, the pipeline stage by stage, and the SQL of the queries."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolsift.llm import minhash, mixing, packing, shingles, tokens
from poolsift.llm.common import table
from poolsift.llm import connected
from poolsift.llm.connected import components
from poolsift.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]


def shingle_set(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def plain_components(rows, width, percent):
    """doc_id -> smallest id in reach, over all pairs; rows that share an id are one."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingle_set(t, width))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases[:4] if rng.random() < 0.5 else bases))
        for _ in range(rng.randint(0, max(1, len(w) // 15))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w[0] = w[0].upper()
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("width,block", [(2, 512), (5, 7)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    rows = near_copies(width) + [(1000, None), (1003, ""), (1006, " \n"), (1009, "single"), (1012, "SINGLE "), (1015, "one two"),
                                 (1018, "two one"), (0, "another text under the same number"), (1021, "another text under the same number"),
                                 (1024, "long " * 30_000), (1027, "long " * 20_000), (1030, "x y"), (3, near_copies(width)[1][1])]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in [*rows, (None, rows[0][1])]], "doc_id long, text string, bands int, __id string")
    got = minhash.near_duplicates(df, width, 80).collect()
    want = plain_components(rows, width, 80)
    assert len(got) == len(rows) + 1
    n = {(i, len(shingle_set(t, width))) for i, t in rows}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.n_shingles) in n
            assert r.component_id == want[r.doc_id] or not r.n_shingles, (r, want[r.doc_id])
            assert r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.component_id, r.kept) for r in minhash.near_duplicates(blank).orderBy("doc_id").collect()] == [(1, True), (2, True)]


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        common = int(800 * share)
        half = (800 - common) // 2
        a, b = np.sort(both[:common + half]), np.sort(np.concatenate([both[:common], both[common + half:common + 2 * half]]))
        s = shingles.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((s[0] == s[1]).mean() - common / (common + 2 * half)) < 0.12
    tiny = shingles.sketches(both[:3], np.array([0, 1, 1, 3]))
    full = np.iinfo(np.uint64).max
    assert (tiny[[0, 2]] != full).all() and (tiny[1] == full).all()


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (200, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 260)) and got[301] == 300
    assert 5 not in got and len(got) == 61 + 61 + 2


def test_components_by_rounds_equal_one_task(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    want = sorted(tuple(r) for r in components(df).collect())
    monkeypatch.setattr(connected, "EDGES_A_TASK", 20)
    monkeypatch.setattr(connected, "HELD_NODES", 15)
    assert sorted(tuple(r) for r in components(df).collect()) == want
    assert components(df.limit(0)).count() == 0


def test_components_take_no_star_step_when_contraction_suffices(spark, monkeypatch):
    # 400 edges that 30 nodes repeat in ten tasks: what contraction leaves fits one task
    rng = random.Random(6)
    edges = [(x, x + rng.choice([0, 10, 20])) for x in (rng.randrange(10) for _ in range(400))]
    df = spark.createDataFrame(edges, "u long, v long").repartition(10)
    want = sorted(tuple(r) for r in components(df).collect())
    monkeypatch.setattr(connected, "EDGES_A_TASK", 40)
    monkeypatch.setattr(connected, "_to_smallest", None)
    assert sorted(tuple(r) for r in components(df).collect()) == want
    assert {c for _, c in want} == {min(u, v) % 10 for u, v in edges if u != v}


def test_small_graph_in_many_partitions_is_counted_by_few_tasks(spark):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long").repartition(64)
    sc.setJobGroup("small graph", "")
    try:
        assert components(df).filter("component = 0").count() == 51
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sizes = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("small graph") for s in tracker.getJobInfo(j).stageIds
             if tracker.getStageInfo(s) is not None]
    # they are made and written once in their own partitions
    assert sum(n >= 64 for n in sizes) <= 1, sizes


def test_forest_equals_union_find():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (50, 30), (200, 180), (3000, 2600)):
        u, v = rng.integers(-n, n, m), rng.integers(-n, n, m)
        up = {x: x for x in [*u.tolist(), *v.tolist()]}
        for _ in range(m):
            for a, b in zip(u.tolist(), v.tolist()):
                up[a] = up[b] = min(up[a], up[b], up[up[a]], up[up[b]])
            if all(up[a] == up[b] for a, b in zip(u.tolist(), v.tolist())):
                break
        assert dict(zip(*(x.tolist() for x in connected.forest(u, v)))) == {x: r for x, r in up.items() if x != r}
    path = np.random.default_rng(4).permutation(100_000)
    nodes, roots = connected.forest(path[:-1], path[1:])
    assert len(nodes) == 99_999 and not roots.any()
    assert len(connected.forest(path[:0], path[:0])[0]) == 0


def boilerplate(n, seed=0):
    """Texts of 200 shingles of which 46 % are common: pairwise similarity 0.3, no link."""
    return [(i, " ".join(f"common{k}" for k in range(93)) + " " + " ".join(f"own{seed}x{i}x{k}" for k in range(108))) for i in range(n)]


def test_boilerplate_makes_no_families(spark, monkeypatch):
    dealt = []
    plain = minhash._family_links

    def counted(rows, *args):
        dealt.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(minhash, "_family_links", counted)
    for n in (300, 600):
        out = minhash.near_duplicates(spark.createDataFrame(boilerplate(n), "doc_id long, text string")).collect()
        assert all(r.kept for r in out) and len(out) == n
    assert dealt[0] <= 30 and dealt[1] <= 60


def test_a_large_group_of_near_copies_costs_one_row_per_member(spark, monkeypatch):
    """The sketches that buckets deal out stay in proportion to the group; all members end in one component."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 16)
    dealt = []
    plain = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda rows: dealt.append(plain(rows).count()) or plain(rows))
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    for n in (100, 300):
        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(150)] = f"x{rng.random()}"
            rows.append((i, " ".join(w)))
        out = minhash.near_duplicates(spark.createDataFrame(rows + boilerplate(20), "doc_id long, text string")).collect()
        assert sum(r.component_id == 0 for r in out if r.n_shingles < 180) >= n
    assert dealt[1] <= 4 * max(dealt[0], 100)


def test_one_id_on_a_third_of_all_rows(spark):
    rows = near_copies(3, 60) + [(7, f"unlike text {i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)] + [(9, "the same words again and again")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, 2, 80)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


# -------------------------------------------------------------- pipeline

def plain_passes(text):
    """The rules of the current policy, counted plainly."""
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    fives = defaultdict(list)
    for i in range(len(w) - 4):
        fives[tuple(w[i:i + 5])].append(i)
    repeated = {i + k for at in fives.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, letters, upper = sum(map(len, w)), len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    return not (len(w) < 10 or 100 * len(repeated) > 20 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * len(w)
                or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or chars < 2 * len(w) or chars > 15 * len(w) or 100 * upper > 50 * letters)


def test_every_stage_against_a_plain_version(spark, tmp_path):
    from .test_filters import plain_line_dedup

    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [f.__name__ for f in stages.values()] == ["quality_rules", "line_chunks", "near_duplicates", "mix_sources", "pack_windows"]

    out = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect() if plain_passes(r.text))
    out.write.parquet(f"{tmp_path}/1")
    docs = spark.read.parquet(f"{tmp_path}/1")

    want = plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    before = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.line_chunks(spark, docs, SMALL)
    assert out.columns == columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in want.items() if words(t) or t == before[i]}
    assert all(r.n_chars == len(r.text) for r in out.collect())
    out.write.parquet(f"{tmp_path}/2")
    docs = spark.read.parquet(f"{tmp_path}/2")

    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in want.items() if i == c)
    out.write.parquet(f"{tmp_path}/3")
    docs = spark.read.parquet(f"{tmp_path}/3")

    # rates by a plain projected gradient over the posteriors; a document's copies are its rate, rounded up or down
    found = mixing.document_rates(docs, table(spark, SMALL, "labels")).collect()
    p, t = np.array([r["__p"] for r in found]), np.array([r["__tokens"] for r in found], float)
    floor = (p[:, 0] >= p.max(1)).astype(float)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * (t @ p)
    rates, h = np.ones(len(t)), np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    for _ in range(20_000):
        rates = np.maximum(floor, rates - p @ ((t * rates) @ p - want) / h)
    out = corpus_pipeline.mix_sources(spark, docs, SMALL)
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert out.columns == columns and set(got) <= {r["__id"] for r in found}
    copies = np.array([got.get(r["__id"], 0) for r in found])
    assert (copies >= floor).all() and np.abs((t * copies) @ p - (t * rates) @ p).max() < 0.1 * t.sum()
    out.write.parquet(f"{tmp_path}/4")
    docs = spark.read.parquet(f"{tmp_path}/4")

    last = corpus_pipeline.pack_windows(spark, docs, SMALL).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: len(tokens.encoder(tokens.default_path()).ids(t)) // 4 + 1 for i, t in texts.items()}
    total = defaultdict(int)
    for r in last:
        total[r.doc_id] += r.length
    assert dict(total) == {i: n * got[i] for i, n in ids.items()}
    seq = defaultdict(int)
    for r in last:
        seq[r.sequence_id] += r.length
    assert max(seq.values()) <= packing.WINDOW


def test_pipeline_runs_whole_and_stages_take_odd_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == packing.NAMES
    text = "\n".join(" ".join(f"word{k}x{m}" for m in range(9)) for k in range(8))
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.quality_rules(spark, docs, SMALL).count() == 4
    lines = corpus_pipeline.line_chunks(spark, docs, SMALL).collect()
    assert sum(r.text == text for r in lines) == 2 and sum(not r.text for r in lines) == 2
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == \
        [(False, 1), (False, 2), (False, 3), (True, 0)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_duplicates_judge_texts_not_ids(spark):
    copied, clean, other = (" ".join(f"{name}{m}" for m in range(60)) for name in ("copied", "clean", "other"))
    rows = [(1, copied), (5, clean), (5, copied + " more"), (5, clean), (7, ""), (7, other), (8, other + " more"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == \
        sorted([(1, copied), (5, clean), (7, ""), (7, other), (9, None), (9, "")], key=str)


def test_stages_give_clashing_columns_back(spark):
    docs = table(spark, SMALL, "documents").limit(60)
    own = {"__unit": "u", "__n": "x", "__lines": "l", "__p": "p", "row": "r", "text_hash": "h", "c0": "c", "__copies": "k", "domain": "d"}
    wide = docs.withColumns({k: F.concat(F.lit(v), F.col("doc_id").cast("string")) for k, v in own.items()}) \
        .withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).checkpoint()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns and out.count() > 0, name
        assert all(r[k] == f"{v}{r.doc_id}" for r in out.collect() for k, v in own.items()), name
        plain = sorted(r.doc_id for r in stage(spark, docs.checkpoint(), SMALL).collect())
        assert sorted(r.doc_id for r in out.collect()) == plain, name
    assert corpus_pipeline.pack_windows(spark, wide, SMALL).count() > 0


def test_repeated_rows_leave_the_one_that_sorts_first(spark):
    text = " ".join(f"w{m}" for m in range(30))
    rows = [(4, text, lang, source, 1) for lang, source in (("fr", "b"), ("en", "z"), (None, "c"), ("en", "a"))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert [(r.lang, r.source) for r in out] == [(None, "c")]


# ------------------------------------------------------------------- SQL

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
