"""Repeated substrings: pieces of the method, and whole results against a plain scan."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from poolsift.llm import suffixes as S


def plain(rows, length=S.LENGTH):
    """(id, spans, digest) by looking every string up in the documents with smaller ids."""
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if any(j is not None and i is not None and j < i and s in (t or "").encode() for j, t in rows):
                gone[p:p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(gone):
            if gone[p]:
                e = p
                while e < len(gone) and gone[e]:
                    e += 1
                spans.append((p, e))
                p = e
            p += 1
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256)
                   for r in S.repeated_spans(df).collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(2, 7))) for _ in range(40)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a:a + rng.randint(20, len(p))])
            elif kind < 0.5:
                parts.append(rng.choice(["z" * rng.randint(40, 160), "ab" * rng.randint(20, 90), "é" * rng.randint(10, 60), "\0" * 70]))
            else:
                parts.append(" ".join(rng.choices(words, k=rng.randint(1, 25))))
        rows.append((rng.choice([i, i, i + 1000]), "\n".join(parts)))
    return rows


def test_equal_to_a_plain_scan(spark):
    rows = corpus(1) + [(None, "z" * 80), (5000, None), (5001, ""), (5002, "é" * 25), (5003, "x" * 49), (5004, "z" * 50)]
    assert found(spark, rows) == plain(rows)


def test_repeated_rows_ties_and_long_text(spark):
    line = "one line that stands in very many of the documents here, word for word"
    rows = [(i, line) for i in range(30)] + [(3, line), (3, line), (7, "abc " * 20_000 + line), (90, ("abc " * 30_000) + "end")]
    assert [r[:3] for r in found(spark, rows) if r[0] == 0] == [(0, len(line), [])]
    got = {(r[0], r[1]): r for r in found(spark, rows)}
    assert got[90, 120_003][2] == [(0, 120_000)]
    assert got[7, 80_000 + len(line)][2] == [(80_000, 80_000 + len(line))] or got[7, 80_000 + len(line)][2][-1][1] == 80_000 + len(line)
    assert sum(1 for r in found(spark, rows) if r[0] == 3 and r[2] == [(0, len(line))]) == 3


def test_empty_table_and_extra_columns(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a" * 60, 7, "x"), (2, "a" * 55, 8, "y")], "doc_id long, text string, chunk int, __id string")
    assert {r.doc_id: len(r.spans) for r in S.repeated_spans(df).collect()} == {1: 0, 2: 1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=S.KEY, max_size=S.KEY), min_size=1, max_size=40), st.integers(1, 5), st.integers(0, 1))
def test_loser_tree_merges_front_coded_runs(keys, k, common):
    keys = [b"p" * 40 * common + x[40 * common:] for x in keys]
    runs = []
    for i in range(k):
        own = sorted(set(keys[i::k]) | set(keys[:3]))
        rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, S.KEY)
        back, lcp = S.decode(S.front_code(rows), len(rows))
        assert np.array_equal(back, rows)
        runs.append((back, lcp))
    run, row, lcp = S.merge(runs)
    merged = [runs[a][0][b].tobytes() for a, b in zip(run, row)]
    assert merged == sorted(r.tobytes() for rows, _ in runs for r in rows)
    assert np.array_equal(lcp, S.common_prefix(np.frombuffer(b"".join(merged), np.uint8).reshape(-1, S.KEY)))


def test_every_window_has_one_anchor_and_equal_windows_agree():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    off = np.array([0, 30, 30, 2000, 5000])
    place, least, most, h = S.anchors(data, off)
    seen = {}
    for p, a, b, x in zip(place.tolist(), least.tolist(), most.tolist(), h.tolist()):
        for left in range(a, b + 1):
            assert p - left not in seen
            seen[p - left] = (left, x)
    starts = [s for lo, hi in zip(off[:-1], off[1:]) for s in range(lo, hi - S.LENGTH + 1)]
    assert sorted(seen) == starts
    assert all(seen[100 + i] == seen[3000 + i] for i in range(300))


def test_grams_of_a_document_with_equal_upper_bits_reach_their_own_buckets():
    def sent(*hashes):
        chunk = S.Chunk(pa.table({"__id": pa.array([1], pa.int64()), "__text": ["x"]}))
        chunk.hash, chunk.doc = np.array(hashes, np.uint64), np.zeros(len(hashes), np.int64)
        return chunk.grams(4)

    first, second = (7 << 32) | 1, (7 << 32) | 2
    bucket, upper, number = sent(first, second, first)
    assert bucket.tolist() == [1, 2] and upper.tolist() == [7, 7] and number.tolist() == [0, 1, 0]
    # another document has the second gram only: it is repeated, for both
    other, same, _ = sent(second)
    met = pa.table({"bucket": pa.array([2, 2], pa.int32()), "chunk": pa.array([0, 1], pa.int32()), "n": pa.array([1, 1], pa.int32()),
                    "hashes": [upper[bucket == 2].tobytes(), same[other == 2].tobytes()]})
    assert S._find_repeated(met).num_rows == 2


def test_rows_of_one_id_and_of_none_are_dealt_over_chunks(spark, monkeypatch):
    rows = [(5, f"a text of its own, number {i}") for i in range(300)] + [(None, "the same text")] * 200 + [(None, None)]

    def group_sizes(buckets):
        def run(docs, replies):
            n = docs.num_rows
            return pa.table({"doc_id": pa.array([None] * n, pa.int64()), "n_bytes": pa.array([n] * n, pa.int64()),
                             "spans": pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                             "kept_sha256": ["dealt"] * n})
        return run

    assert found(spark, rows[-3:]) == plain(rows[-3:])
    monkeypatch.setattr(S, "LEAST_BYTES", 1000)
    monkeypatch.setattr(S, "_judge", group_sizes)
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 501
    dealt = [r.n_bytes for r in got if r.kept_sha256 == "dealt"]
    assert len(dealt) == 300 and max(dealt) < 150
