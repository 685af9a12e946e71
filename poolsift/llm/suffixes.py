"""Repeated substrings across documents by a distributed, common-prefix-aware merge sort.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id.  All strings of that length are compared without
writing out a suffix for each of them:

1.  Anchors.  Every window of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` grams; its
    anchor is the first of those with the smallest hash.  Equal windows have their
    anchor at the same place, so two windows are equal exactly if their anchors' sides
    are.  A gram is anchor of a run of neighbouring windows.
2.  Grams that occur once in the corpus (by hash, which may only keep too many) end here.
3.  Of the others, the suffix at the anchor and the bytes before it go, as sorted,
    front-coded runs of distinct strings, to the task of their gram.  A loser tree
    merges the runs; it compares bytes only behind the prefix that both are known to
    share.  Common-prefix lengths of the merged order then tell, for every window, the
    smallest id that has it.
4.  Each chunk of documents gets back what is smaller than its own ids.

Documents are shuffled once into chunks, by id and text; the three passes read the same
shuffle.  Rows of one id never take from each other, so they need not meet in a chunk.
Rows with a null id match nothing and are not shuffled.
Each task sends a string once, however often it occurs there: a string that a third of
all documents share is one entry of each run.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, shuffle_parts, utf8
from .shingles import K, mix

LENGTH = 50
GRAM = 24
LEFTS = LENGTH - GRAM + 1             # windows that an anchor may have, by the bytes before it
WORDS = -(-(LENGTH + LEFTS - 1 + 2) // 8)
KEY = 8 * WORDS                       # suffix, reversed bytes before it, first and last window; zero-filled
SEGMENT = 1 << 18                     # places of one numpy pass; below 2^24
CHUNK_BYTES = 16 << 20                # most text in a chunk (a longer document is a chunk of its own size)
LEAST_BYTES = 1 << 18
CHUNKS_A_TASK = 8
BUCKET_BYTES = 8 << 20                # text whose grams meet in one bucket, about
FAR = np.iinfo(np.int64).max


# ---------------------------------------------------------------- one chunk

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (GRAM - 1 places less than bytes)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = eight[:n] * K(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        h = (h ^ (h >> K(29))) + eight[at:at + n]
        h *= K(0xC2B2AE3D27D4EB4F)
    return mix(h)


def anchors(data: np.ndarray, off: np.ndarray):
    """Anchors of all windows that lie inside one text: place, fewest and most bytes before
    it in its windows, and the gram's hash, in the order of places.

    An anchor whose windows fall into two segments comes twice, with a part each.
    """
    found = []
    ends = off[1:]
    for lo in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[lo:lo + SEGMENT + LENGTH - 1]
        h = gram_hashes(part)
        # 40 hash bits above the place: the smallest is the leftmost of the smallest hash
        m = (h & K(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width, size = 1, LEFTS
        while 2 * width <= size:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < size:
            m = np.minimum(m[:len(m) - (size - width)], m[size - width:])
        start = np.arange(len(m), dtype=np.int64)
        place = (m & K(0xFFFFFF)).astype(np.int64)
        # a window must end where its text ends or before
        text = np.searchsorted(ends, lo + start, side="right")
        inside = lo + start + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        start, place = start[inside], place[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:], [len(start)]]) - 1
        p = place[first]
        # anchors have small hashes; mixed again, their bits are even
        found.append((p + lo, p - start[last], p - start[first], mix(h[p] + K(1))))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def keys_of(data: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(anchors, KEY) bytes: the suffix, the bytes before it from right to left, least, most."""
    n = len(place)
    out = np.zeros((n, KEY), np.uint8)
    if n == 0:
        return out
    at = place[:, None] + np.arange(LENGTH)
    inside = np.arange(LENGTH) < (LENGTH - least)[:, None]
    out[:, :LENGTH] = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
    at = place[:, None] - 1 - np.arange(LEFTS - 1)
    inside = np.arange(LEFTS - 1) < most[:, None]
    out[:, LENGTH:LENGTH + LEFTS - 1] = np.where(inside, data[np.maximum(at, 0)], 0)
    out[:, LENGTH + LEFTS - 1] = least
    out[:, LENGTH + LEFTS] = most
    return out


def distinct_keys(keys: np.ndarray, bucket: np.ndarray):
    """Sorted distinct (bucket, key) rows: their order, first rows, and each row's number among them."""
    words = keys.view(">u8")
    order = np.lexsort([words[:, w] for w in range(WORDS - 1, -1, -1)] + [bucket])
    s, b = words[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]).any(1) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as prefix lengths and what follows the prefixes."""
    lcp = common_prefix(rows)
    rest = rows[np.arange(rows.shape[1]) >= lcp[:, None]]
    return lcp.astype(np.uint8).tobytes() + rest.tobytes()


def decode(blob: bytes, n: int):
    """Rows and prefix lengths of a front-coded run."""
    raw = np.frombuffer(blob, np.uint8)
    lcp = raw[:n].astype(np.int64)
    mask = np.arange(KEY) >= lcp[:, None]
    rows = np.zeros((n, KEY), np.uint8)
    rows[mask] = raw[n:]
    # a byte inside the prefix comes from the last row whose prefix ended before it
    source = np.maximum.accumulate(np.where(mask, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, 0), lcp


class Chunk:
    """The documents of one chunk, in the order of id and text."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("__id", "ascending"), ("__text", "ascending")])
        self.ids = table.column("__id").to_numpy().astype(np.int64)
        self.data, self.off = utf8(table.column("__text").cast(pa.string()))
        self.place, self.least, self.most, self.hash = anchors(self.data, self.off)
        self.doc = np.searchsorted(self.off, self.place, side="right") - 1

    def bucket(self, buckets: int) -> np.ndarray:
        return (self.hash & K(0xFFFFFF)).astype(np.int64) % buckets

    def grams(self, buckets: int):
        """The distinct (document, gram) pairs by bucket: bucket and 32 hash bits of each, and each anchor's number among them."""
        # by the full hash: the bucket comes from bits that are not among those sent
        by = np.lexsort([self.hash, self.doc])
        d, h = self.doc[by], self.hash[by]
        new = np.ones(len(by), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        first = by[new]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(new) - 1
        bucket = self.bucket(buckets)[first]
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return bucket[order], (self.hash >> K(32)).astype("<u4")[first[order]], rank[number]

    def candidates(self, chosen: np.ndarray, buckets: int) -> None:
        """Keeps the chosen anchors; ``entry`` numbers the distinct strings, bucket by bucket."""
        for name in ("place", "least", "most", "hash", "doc"):
            setattr(self, name, getattr(self, name)[chosen])
        bucket = self.bucket(buckets)
        keys = keys_of(self.data, self.place, self.least, self.most)
        first, self.entry = distinct_keys(keys, bucket)
        self.keys, self.entry_bucket = keys[first], bucket[first]
        self.smallest = np.full(len(first), FAR)
        np.minimum.at(self.smallest, self.entry, self.ids[self.doc])
        self.range = (self.least[first], self.most[first])

    def smaller(self, replies: dict) -> np.ndarray:
        """(entries, LEFTS) smallest id known for each window, FAR where there is no window."""
        n = len(self.keys)
        l = np.arange(LEFTS)
        valid = (l >= self.range[0][:, None]) & (l <= self.range[1][:, None])
        best = np.where(valid, self.smallest[:, None], FAR)
        starts = np.searchsorted(self.entry_bucket, np.arange(self.entry_bucket.max(initial=0) + 2))
        for b, (rows, at, doc) in replies.items():
            rows = rows + starts[b]
            # each change of the smallest id holds up to the next change of the same row
            told = np.zeros((n, LEFTS), bool)
            told[rows, at] = True
            value = np.zeros((n, LEFTS), np.int64)
            value[rows, at] = doc
            some = np.unique(rows)
            source = np.maximum.accumulate(np.where(told[some], l, -1), axis=1)
            heard = np.take_along_axis(value[some], np.maximum(source, 0), 1)
            best[some] = np.where(valid[some] & (source >= 0), np.minimum(best[some], heard), best[some])
        return best

    def covered(self, best: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        depth = np.zeros(len(self.data) + 1, np.int32)
        for lo in range(0, len(self.entry), 100_000):
            part = slice(lo, lo + 100_000)
            gone = best[self.entry[part]] < self.ids[self.doc[part]][:, None]
            some = gone.any(1)
            # windows of one anchor overlap: the outermost two bound what they cover together
            left = LEFTS - 1 - gone[:, ::-1].argmax(1)
            np.add.at(depth, (self.place[part] - left)[some], 1)
            np.add.at(depth, (self.place[part] - gone.argmax(1) + LENGTH)[some], -1)
        return np.cumsum(depth[:-1]) > 0


# ------------------------------------------------------------- merging runs

def merge(runs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs of distinct rows, given as (rows, prefix lengths).

    Returns run and row of each output and the bytes that it shares with the output
    before.  A loser tree holds, at each node, the loser and how much it shares with
    the winner that passed; of two candidates the one that shares more with the last
    output is the smaller, and only equals are compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    words = [None] * k
    lcps = [None] * k
    size = [0] * k
    for i, (rows, lcp) in enumerate(runs):
        words[i] = rows.view(">u8").tolist()
        lcps[i] = lcp.tolist()
        size[i] = len(rows)
    at = [0] * k
    head = [words[i][0] if size[i] else None for i in range(k)]
    loser, shared = [0] * k, [0] * k

    def less(a, b, known):
        """Whether row a is below row b, and what they share; the first ``known`` bytes are equal."""
        x, y = head[a], head[b]
        for w in range(known >> 3, WORDS):
            if x[w] != y[w]:
                return x[w] < y[w], 8 * w + 8 - ((x[w] ^ y[w]).bit_length() + 7) // 8
        return a < b, KEY

    def first(node):
        if node >= k:
            return node - k
        a, b = first(2 * node), first(2 * node + 1)
        if head[b] is None or head[a] is None:
            win, lose, both = (a, b, -1) if head[b] is None else (b, a, -1)
        else:
            a_first, both = less(a, b, 0)
            win, lose = (a, b) if a_first else (b, a)
        loser[node], shared[node] = lose, both
        return win

    winner = first(1) if k > 1 else 0
    out_run, out_row, out_lcp = [], [], []
    known = 0
    total = sum(size)
    for _ in range(total):
        i = at[winner]
        out_run.append(winner)
        out_row.append(i)
        out_lcp.append(known)
        i += 1
        at[winner] = i
        if i < size[winner]:
            head[winner] = words[winner][i]
            known = lcps[winner][i]
        else:
            head[winner] = None
            known = -1
        node = (winner + k) >> 1
        while node:
            s = shared[node]
            if s > known:
                other = loser[node]
                loser[node], shared[node] = winner, known
                winner, known = other, s
            elif s == known >= 0:
                other = loser[node]
                below, both = less(other, winner, known)
                shared[node] = both
                if below:
                    loser[node] = winner
                    winner = other
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_row, np.int64), np.array(out_lcp, np.int64)


def smallest_ids(rows: np.ndarray, lcp: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(rows, LEFTS) smallest id that has each window; rows are sorted and distinct."""
    n = len(rows)
    least, most = rows[:, LENGTH + LEFTS - 1], rows[:, LENGTH + LEFTS]
    best = np.full((n, LEFTS), FAR)
    before = rows[:, LENGTH:LENGTH + LEFTS - 1]
    padded = np.zeros((n, 8 * -(-(LEFTS - 1) // 8)), np.uint8)
    padded[:, :LEFTS - 1] = before
    w = padded.view(">u8")
    order = np.lexsort([w[:, i] for i in range(w.shape[1] - 1, -1, -1)])
    left_lcp = common_prefix(before[order])
    right_lcp = np.minimum(lcp, LENGTH)
    left = np.empty(n, np.int64)
    for l in range(LEFTS):
        has = np.nonzero((least <= l) & (most >= l))[0]
        if not len(has):
            continue
        right = np.cumsum(right_lcp < LENGTH - l)
        left[order] = np.cumsum(left_lcp < l)
        pair = right[has] * (n + 1) + left[has]
        by = np.argsort(pair, kind="stable")
        p = pair[by]
        start = np.nonzero(np.concatenate([[True], p[1:] != p[:-1]]))[0]
        low = np.minimum.reduceat(ids[has][by], start)
        best[has[by], l] = np.repeat(low, np.diff(np.concatenate([start, [len(p)]])))
    return best


# ------------------------------------------------------------------- Spark

ANCHOR_SCHEMA = "bucket int, chunk int, n int, hashes binary"
RUN_SCHEMA = "bucket int, chunk int, n int, run binary, ids binary"
REPLY_SCHEMA = "chunk int, bucket int, body binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice) of equal neighbours."""
    if len(bucket):
        cut = np.nonzero(bucket[1:] != bucket[:-1])[0] + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
            yield int(bucket[lo]), slice(lo, hi)


def _table(schema: list, rows: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns)})


I32, BIN = pa.int32(), pa.binary()


def _send_grams(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        bucket, hashes, _ = Chunk(table).grams(buckets)
        return _table([("bucket", I32), ("chunk", I32), ("n", I32), ("hashes", BIN)],
                      [(b, number, s.stop - s.start, hashes[s].tobytes()) for b, s in _by_bucket(bucket)])
    return run


def _find_repeated(table: pa.Table) -> pa.Table:
    """Which grams of a bucket come from more than one document, as a bit mask per chunk."""
    n = table.column("n").to_numpy()
    h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), "<u4")
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.cumsum(n)
    bucket, out = table.column("bucket")[0].as_py(), []
    for chunk, lo, hi in zip(table.column("chunk").to_pylist(), (ends - n).tolist(), ends.tolist()):
        if twice[lo:hi].any():
            out.append((chunk, bucket, np.packbits(twice[lo:hi]).tobytes()))
    return _table([("chunk", I32), ("bucket", I32), ("body", BIN)], out)


def _send_runs(buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if replies.num_rows and docs.num_rows:
            number = replies.column("chunk")[0].as_py()
            chunk = Chunk(docs)
            bucket, _, rank = chunk.grams(buckets)
            chosen = np.zeros(len(bucket), bool)
            where = dict(_by_bucket(bucket))
            for b, body in zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist()):
                s = where[b]
                chosen[s] = np.unpackbits(np.frombuffer(body, np.uint8), count=s.stop - s.start).astype(bool)
            chosen = chosen[rank]
            chunk.candidates(chosen, buckets)
            pack = zstandard.ZstdCompressor(3)
            # the choice itself comes back to the chunk by way of a bucket of its own
            out.append((-1 - number, number, 0, pack.compress(np.packbits(chosen).tobytes()), b""))
            for b, s in _by_bucket(chunk.entry_bucket):
                out.append((b, number, s.stop - s.start, pack.compress(front_code(chunk.keys[s])), chunk.smallest[s].astype("<i8").tobytes()))
        return _table([("bucket", I32), ("chunk", I32), ("n", I32), ("run", BIN), ("ids", BIN)], out)
    return run


REPLY = np.dtype([("row", "<u4"), ("left", "u1"), ("doc", "<i8")])


def _merge_runs(table: pa.Table) -> pa.Table:
    """Per chunk, the windows of its strings that a smaller id than its own has."""
    bucket = table.column("bucket")[0].as_py()
    schema = [("chunk", I32), ("bucket", I32), ("body", BIN)]
    if bucket < 0:
        return _table(schema, list(zip(table.column("chunk").to_pylist(), [-1] * table.num_rows, table.column("run").to_pylist())))
    table = table.sort_by("chunk")
    unpack = zstandard.ZstdDecompressor()
    sizes = table.column("n").to_pylist()
    runs = [decode(unpack.decompress(r), n) for r, n in zip(table.column("run").to_pylist(), sizes)]
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
    base = np.cumsum([0, *sizes])
    run, row, lcp = merge(runs)
    at = base[run] + row
    rows = np.concatenate([r[0] for r in runs])[at]
    new = lcp < KEY
    new[0] = True
    first = np.nonzero(new)[0]
    low = np.minimum.reduceat(ids[at], first)
    best = smallest_ids(rows[first], lcp[first], low)
    own = np.empty(len(at), np.int64)          # number of the merged string, by entry
    own[at] = np.cumsum(new) - 1
    out = []
    for i, chunk in enumerate(table.column("chunk").to_pylist()):
        part = slice(base[i], base[i + 1])
        heard = best[own[part]]
        less = heard < ids[part][:, None]
        some = np.nonzero(less.any(1))[0]
        if len(some):
            heard = heard[some]
            told = np.ones(heard.shape, bool)
            told[:, 1:] = heard[:, 1:] != heard[:, :-1]
            told &= heard != FAR
            r, left = np.nonzero(told)
            body = np.empty(len(r), REPLY)
            body["row"], body["left"], body["doc"] = some[r], left, heard[r, left]
            out.append((chunk, bucket, zstandard.ZstdCompressor(3).compress(body.tobytes())))
    return _table(schema, out)


def _judge(buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(docs)
        gone = np.zeros(len(chunk.data), bool)
        unpack = zstandard.ZstdDecompressor()
        answers, chosen = {}, None
        for b, body in zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist()):
            raw = unpack.decompress(body)
            if b < 0:
                chosen = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(chunk.place)).astype(bool)
            else:
                a = np.frombuffer(raw, REPLY)
                answers[b] = (a["row"].astype(np.int64), a["left"].astype(np.int64), a["doc"])
        if chosen is not None and chosen.any():
            chunk.candidates(chosen, buckets)
            gone = chunk.covered(chunk.smaller(answers))
        out = []
        blob, off = chunk.data.tobytes(), chunk.off.tolist()
        for i, lo, hi in zip(chunk.ids.tolist(), off[:-1], off[1:]):
            spans, kept = [], blob[lo:hi]
            if gone[lo:hi].any():
                runs = np.diff(np.concatenate([[False], gone[lo:hi], [False]]).astype(np.int8))
                spans = [{"start": x, "end": y} for x, y in zip(np.nonzero(runs == 1)[0].tolist(), np.nonzero(runs == -1)[0].tolist())]
                kept = chunk.data[lo:hi][~gone[lo:hi]].tobytes()
            out.append((i, hi - lo, spans, hashlib.sha256(kept).hexdigest()))
        return _table([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())], out)
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept_sha256`` per input row.

    ``spans`` are the maximal runs of bytes of the UTF-8 text that are covered by
    50-byte strings which also start in a document with a smaller id; the digest
    is of the remaining bytes, concatenated.  Null texts are empty.  Rows that
    share an id never take from each other.  A row with a null id neither loses
    nor takes anything.  Texts below 50 bytes lose nothing.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = shuffle_parts(spark)
    chunks = max(1, min(CHUNKS_A_TASK * parts, math.ceil(total / LEAST_BYTES)), math.ceil(total / CHUNK_BYTES))
    buckets = max(1, min(parts, math.ceil(total / (1 << 20))), math.ceil(total / BUCKET_BYTES))
    chunked = rows.filter(F.col("__id").isNotNull()).select(
        F.pmod(F.xxhash64("__id", "__text"), F.lit(chunks)).cast("int").alias("chunk"), "__id", "__text")
    by_chunk = chunked.groupBy("chunk")
    grams = by_chunk.applyInArrow(_send_grams(buckets), ANCHOR_SCHEMA)
    repeated = grams.groupBy("bucket").applyInArrow(_find_repeated, REPLY_SCHEMA)
    runs = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(_send_runs(buckets), RUN_SCHEMA)
    replies = runs.groupBy("bucket").applyInArrow(_merge_runs, REPLY_SCHEMA)
    judged = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_judge(buckets), RESULT_SCHEMA)
    apart = rows.filter(F.col("__id").isNull()).select(
        F.col("__id").alias("doc_id"), F.octet_length("__text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.sha2("__text", 256).alias("kept_sha256"))
    return judged.unionByName(apart)
