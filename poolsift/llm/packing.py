"""Packing token sequences by multiway differencing.

Documents are cut into full windows and a tail; tails are cut into pieces of
at most ``PIECE`` tokens.  The pieces of a few hundred documents are dealt to
windows by Karmarkar-Karp differencing: partial partitions are merged two at a
time, largest imbalance first, the fullest window of one with the emptiest of
the other.  If a window exceeds its capacity, the number of windows rises.

Every task packs its own input partition as it streams by, so nothing is
shuffled; the packing follows from the order of the rows.  Give it a stored
table (or a checkpoint), whose partitions read alike when a task is repeated.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .tokens import default_path, encoder

WINDOW = 2048
PIECE = 512
GROUP = 512            # documents whose tails are packed together
END = (1).to_bytes(4, "little")
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each piece, by Karmarkar-Karp differencing of partial partitions.

    A partial partition is a vector of window sums, least sum taken off, with the
    tree of pieces behind each sum.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)    # inner nodes of the trees; pieces are 0..n-1
    free = n
    parts, heap = {}, []
    for i, s in enumerate(sizes.tolist()):
        # one window holds the piece: (sums above the least, ascending), (trees)
        parts[i] = (np.array([s], np.int64), np.array([i]))
        heap.append((-s, i))
    heapq.heapify(heap)
    key = n
    while len(heap) > 1:
        (sa, ta), (sb, tb) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        # vectors hold only the non-empty windows, fullest last; the rest are empty with sum 0
        overlap = len(sa) + len(sb) - windows
        if overlap <= 0:
            sums, trees = np.concatenate([sa, sb]), np.concatenate([ta, tb])
        else:
            # the emptiest of either meet the fullest of the other
            if len(sa) < len(sb):
                sa, ta, sb, tb = sb, tb, sa, ta
            # of b's windows, the fullest go to a's empty ones, then to a's emptiest
            room = windows - len(sa)
            stay = len(sb) - room
            joined = sa[:stay] + sb[:stay][::-1]
            nodes = np.arange(free, free + stay)
            left[nodes], right[nodes] = ta[:stay], tb[:stay][::-1]
            free += stay
            sums = np.concatenate([joined, sa[stay:], sb[stay:]])
            trees = np.concatenate([nodes, ta[stay:], tb[stay:]])
        order = np.argsort(sums, kind="stable")
        sums, trees = sums[order], trees[order]
        if len(sums) == windows:
            sums = sums - sums[0]
        parts[key] = (sums, trees)
        heapq.heappush(heap, (-int(sums[-1] - (sums[0] if len(sums) == windows else 0)), key))
        key += 1
    out = np.zeros(n, np.int64)
    for w, tree in enumerate(parts.popitem()[1][1].tolist()):
        todo = [tree]
        while todo:
            t = todo.pop()
            if t < n:
                out[t] = w
            else:
                todo += (left[t], right[t])
    return out


def pack(sizes, capacity: int = WINDOW) -> np.ndarray:
    """Window of each piece: as few windows as differencing fits into the capacity."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("a piece exceeds the capacity")
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = difference(sizes, windows)
        if not len(sizes) or np.bincount(where, sizes).max() <= capacity:
            return where
        windows += max(1, windows // 200)


def cut(total: int, capacity: int, piece: int):
    """(start, length) of the full windows and of the tail's pieces, near-equal in length."""
    full = total // capacity
    tail = total - full * capacity
    n = -(-tail // piece)
    edges = [full * capacity + tail * i // n for i in range(n + 1)] if n else []
    return [(i * capacity, capacity) for i in range(full)], [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW,
                   piece: int = PIECE, group: int = GROUP, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the tokenizer's ids of its text (null: none) and id 1.  Each id
    lies in one piece, each piece in one sequence of at most ``capacity`` ids, from
    offset 0 without gaps.  Null ids and repeated rows are packed like any other
    row; other columns are not read.
    """
    ready(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(path)
        base = TaskContext.get().partitionId() << 40
        used = 0
        out, tails = [], []

        def place():
            nonlocal used
            where = pack([t[2] for t in tails], capacity)
            filled: dict = {}
            for t, w in zip(tails, where.tolist()):
                at = filled.get(w, 0)
                out.append((*t, base + used + w, at))
                filled[w] = at + t[2]
            used += int(where.max(initial=-1)) + 1
            tails.clear()

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=NAMES)
            out.clear()
            return made

        n_docs = 0
        for b in batches:
            for doc, text in zip(b.column("__id").to_pylist(), b.column("__text")):
                ids = encode.ids(text.as_py()) + END
                total = len(ids) // 4
                full, rest = cut(total, capacity, piece)
                for start, length in full:
                    out.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total, base + used, 0))
                    used += 1
                tails += [(doc, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]), total) for s, n in rest]
                n_docs += 1
                if n_docs % group == 0:
                    place()
                if len(out) >= 10_000:
                    yield batch()
        place()
        if out:
            yield batch()

    return rows.mapInArrow(run, SCHEMA)
