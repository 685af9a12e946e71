"""Token ids in files that Re-Pair grammars compress.

Documents go in ascending order of their ids to shards of about ``SHARD_TOKENS``
token ids.  In each shard, frequent pairs of neighbouring symbols are replaced by new
symbols, round after round: a round counts all pairs, takes them from the most
frequent on as long as no two of them can overlap, and replaces their
occurrences.  A shard file holds the rules, the length of each rule's expansion and
sampled places, so that one document is decoded without its neighbours.

A shard file (little-endian; one binary value per row of a Parquet table, which
Spark commits and reads)::

    magic b"RPR1", then uint32: documents, token ids, symbols of the sequence, terminals, rules, rounds
    uint64 ids of the documents (two's complement), uint8 marks of null ids
    uint32 token ids of each document
    uint32 terminals (token ids, ascending); symbol s < terminals stands for the s-th
    uint32 rules made up to the end of each round
    uint32 length of each rule's expansion
    uint32 token ids before every SAMPLE-th symbol of the sequence
    left symbols of the rules, right symbols, the sequence (rule r is symbol terminals + r):
    uint16 if all symbols fit, else uint32
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, shuffle_parts
from .tokens import default_path, encoder

END = 2
SHARD_TOKENS = 1 << 20
MIN_COUNT = 4                # a rule is two symbols and a length: rarer pairs do not pay
LEAST_GAIN = 1 / 50          # rounds go on while one removes this share of the sequence
SAMPLE = 256
TABLE_BITS = 20
MAGIC = b"RPR1"


# ----------------------------------------------------------------- grammar

@dataclass
class Grammar:
    terminals: np.ndarray        # token ids
    rounds: np.ndarray           # rules made up to the end of each round
    left: np.ndarray
    right: np.ndarray
    sequence: np.ndarray

    def lengths(self) -> np.ndarray:
        """Token ids that each symbol stands for."""
        t = len(self.terminals)
        out = np.ones(t + len(self.left), np.int64)
        lo = 0
        for hi in self.rounds.tolist():
            out[t + lo:t + hi] = out[self.left[lo:hi]] + out[self.right[lo:hi]]
            lo = hi
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The token ids behind some symbols; the last round's rules are opened first."""
        t = len(self.terminals)
        starts = np.concatenate([[0], self.rounds[:-1]]).astype(np.int64)
        s = symbols.astype(np.int64)
        for lo in starts[::-1][:len(self.rounds)].tolist():
            opened = s >= t + lo
            if not opened.any():
                continue
            at = np.cumsum(1 + opened) - 1 - opened
            rule = s[opened] - t
            s = np.repeat(s, 1 + opened)
            s[at[opened]] = self.left[rule]
            s[at[opened] + 1] = self.right[rule]
        return self.terminals[s]

    def tokens(self) -> np.ndarray:
        """The token ids behind the whole sequence, by a table of every symbol's expansion.

        Occurrences of one round's rules do not overlap, so its part of the table is
        shorter than the token ids.
        """
        t = len(self.terminals)
        size = self.lengths()
        opened, at = self.terminals, np.zeros(len(size), np.int64)
        at[:t] = np.arange(t)

        def expanded(symbols):
            n = size[symbols]
            ends = np.cumsum(n)
            return opened[np.repeat(at[symbols] - (ends - n), n) + np.arange(n.sum())]

        lo = 0
        for hi in self.rounds.tolist():
            n = size[t + lo:t + hi]
            at[t + lo:t + hi] = len(opened) + np.cumsum(n) - n
            opened = np.concatenate([opened, expanded(np.column_stack([self.left[lo:hi], self.right[lo:hi]]).ravel())])
            lo = hi
        return expanded(self.sequence)


def _chosen(left: np.ndarray, right: np.ndarray, counts: np.ndarray, symbols: int) -> np.ndarray:
    """Places of pairs, most frequent first, of which no two can overlap: a symbol is a left or a right one.

    Roles never change, so pairs that earlier ones rule out are dropped together, after
    1024, 2048, 4096, ... of those left.
    """
    role = bytearray(symbols)
    out: list = []
    rest, step = np.argsort(-counts, kind="stable"), 1024
    while len(rest):
        now, rest = rest[:step], rest[step:]
        step *= 2
        for i, a, b in zip(now.tolist(), left[now].tolist(), right[now].tolist()):
            if a == b:
                if not role[a]:
                    role[a] = 3
                    out.append(i)
            elif role[a] < 2 and role[b] in (0, 2):
                role[a], role[b] = 1, 2
                out.append(i)
        roles = np.frombuffer(role, np.uint8)
        a, b = roles[left[rest]], roles[right[rest]]
        rest = rest[np.where(left[rest] == right[rest], a == 0, (a < 2) & (b % 2 == 0))]
    return np.array(out, np.int64)


def _every_second(at: np.ndarray) -> np.ndarray:
    """Marks, of neighbouring places (pairs of one symbol in a run), the first, third, ..."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return (np.arange(len(at)) - first) % 2 == 0


def compress(ids: np.ndarray) -> Grammar:
    """Re-Pair in rounds over one shard's token ids."""
    present = np.zeros(int(ids.max(initial=0)) + 1, bool)        # (token ids lie below the vocabulary's size)
    present[ids] = True
    terminals = np.nonzero(present)[0]
    seq = (np.cumsum(present) - 1)[ids] if len(ids) else np.zeros(0, np.int64)
    symbols = len(terminals)
    left, right, rounds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    made = 0
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << TABLE_BITS, np.int32)
    while len(seq) > 1:
        key = seq[:-1] * symbols + seq[1:]
        if symbols <= 1 << 16:               # half the bytes to sort
            key = key.astype(np.uint32)
        order = np.sort(key)
        edge = np.concatenate([[0], np.nonzero(order[1:] != order[:-1])[0] + 1])
        counts = np.diff(edge, append=len(order))
        often = counts >= MIN_COUNT
        pairs, counts = order[edge[often]].astype(np.int64), counts[often]
        if not len(pairs):
            break
        pairs = pairs[_chosen(pairs // symbols, pairs % symbols, counts, symbols)]
        # a hash table of the chosen pairs; of two in one place the more frequent one stays
        slot = ((pairs.astype(np.uint64) * multiplier) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        place = np.sort(np.unique(slot, return_index=True)[1])
        pairs, slot = pairs[place], slot[place]
        a, b = pairs // symbols, pairs % symbols
        # only places between a left and a right symbol are looked up
        is_left, is_right = np.zeros(symbols, bool), np.zeros(symbols, bool)
        is_left[a] = is_right[b] = True
        at = np.nonzero(is_left[seq[:-1]] & is_right[seq[1:]])[0]
        found = key[at]
        table[slot] = np.arange(len(pairs))
        rule = table[((found.astype(np.uint64) * multiplier) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        table[slot] = 0                      # (places of no pair lead to the first one, which is compared)
        hit = pairs[rule] == found
        at, rule = at[hit], rule[hit]
        twin = a[rule] == b[rule]
        if twin.any():
            first = ~twin
            first[twin] = _every_second(at[twin])
            at, rule = at[first], rule[first]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = symbols + rule
        gained = len(at) / len(seq)
        seq = seq[keep]
        left.append(a)
        right.append(b)
        made += len(pairs)
        rounds.append(made)
        symbols += len(pairs)
        if gained < LEAST_GAIN:
            break
    return Grammar(terminals.astype(np.uint32), np.array(rounds, np.int64), np.concatenate(left), np.concatenate(right), seq)


# -------------------------------------------------------------- shard files

def to_bytes(doc_ids: list, lengths: list, ids: np.ndarray) -> bytes:
    """One shard file of some documents' token ids, concatenated in order."""
    g = compress(ids)
    size = g.lengths()
    before = np.concatenate([[0], np.cumsum(size[g.sequence])])[:-1]
    header = np.array([len(doc_ids), len(ids), len(g.sequence), len(g.terminals), len(g.left), len(g.rounds)], "<u4")
    narrow = len(g.terminals) + len(g.left) <= 1 << 16
    return b"".join([
        MAGIC, header.tobytes(), np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], "u1").tobytes(), np.array(lengths, "<u4").tobytes(), g.terminals.astype("<u4").tobytes(),
        *(x.astype("<u4").tobytes() for x in (g.rounds, size[len(g.terminals):], before[::SAMPLE])),
        *(x.astype("<u2" if narrow else "<u4").tobytes() for x in (g.left, g.right, g.sequence))])


class Shard:
    """A shard file's contents; token ids are decoded when they are asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard file")
        docs, self.n_tokens, symbols, terminals, rules, rounds = np.frombuffer(blob, "<u4", 6, 4).tolist()
        at = 28

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(take("<u4", docs).astype(np.int64))])
        terms = take("<u4", terminals)
        ends = take("<u4", rounds).astype(np.int64)
        self.size = np.concatenate([np.ones(terminals, np.int64), take("<u4", rules).astype(np.int64)])
        self.sampled = take("<u4", -(-symbols // SAMPLE)).astype(np.int64)
        kind = "<u2" if terminals + rules <= 1 << 16 else "<u4"
        left, right = take(kind, rules).astype(np.int64), take(kind, rules).astype(np.int64)
        self.grammar = Grammar(terms, ends, left, right, take(kind, symbols))

    def tokens(self) -> np.ndarray:
        return self.grammar.tokens()

    def document(self, i: int) -> np.ndarray:
        """Token ids of one document; only the symbols that cover it are expanded."""
        a, b = self.starts[i], self.starts[i + 1]
        if a == b:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.sampled, a, side="right")) - 1
        last = int(np.searchsorted(self.sampled, b, side="left"))
        sequence = self.grammar.sequence[first * SAMPLE:last * SAMPLE]
        reach = self.sampled[first] + np.concatenate([[0], np.cumsum(self.size[sequence])])
        lo, hi = int(np.searchsorted(reach, a, side="right")) - 1, int(np.searchsorted(reach, b, side="left"))
        return self.grammar.expand(sequence[lo:hi])[a - reach[lo]:b - reach[lo]]


# ------------------------------------------------------------------ Spark

def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
                 shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> None:
    """Shard files of all documents, in ascending order of their ids, under ``path``.

    A document is the tokenizer's ids of its text (null: none) and ``end``.  Null ids
    come first; rows that repeat an id are documents of their own, in the stored
    table's order.  Very long documents make a shard of their own size.  An empty table
    writes no shard.  Other columns are not read.  Give it a stored table, which
    reads alike when a task is repeated.
    """
    spark = ready(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
                       F.monotonically_increasing_id().alias("__row"))

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, blobs, size = [], [], [], 0
        last = np.array([end], "<u4").tobytes()

        def out():
            nonlocal shard, before, size
            tokens = np.frombuffer(b"".join(blobs), "<u4")
            own = [i for i in ids if i is not None]
            made = pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "before": before, "n_docs": len(ids), "n_tokens": len(tokens),
                "least_id": min(own, default=None), "largest_id": max(own, default=None), "file": to_bytes(ids, lengths, tokens)}], schema=FILES)
            shard, before, size = shard + 1, before + len(tokens), 0
            for x in (ids, lengths, blobs):
                x.clear()
            return made

        for b in batches:
            for i, text in zip(b.column("__id").to_pylist(), b.column("__text")):
                blob = encode.ids(text.as_py()) + last
                ids.append(i)
                lengths.append(len(blob) // 4)
                blobs.append(blob)
                size += len(blob) // 4
                if size >= shard_tokens:
                    yield out()
        if ids:
            yield out()

    # the row's place parts rows of one id, however many there are
    (rows.repartitionByRange(shuffle_parts(spark), "__id", "__row").sortWithinPartitions("__id", "__row")
     .mapInArrow(run, "part int, shard int, before long, n_docs int, n_tokens long, least_id long, largest_id long, file binary")
     .write.parquet(path))


FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
                   ("least_id", pa.int64()), ("largest_id", pa.int64()), ("file", pa.binary())])


def _part_starts(files: DataFrame) -> DataFrame:
    """``part, ahead``: token ids in the parts before it; one row per part of the write."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("own").over(w), F.lit(0).cast("long")).alias("ahead"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shard files."""
    files = spark.read.parquet(path)

    def run(batches):
        for b in batches:
            for ahead, before, blob in zip(*(b.column(c).to_pylist() for c in ("ahead", "before", "file"))):
                shard = Shard(blob)
                data = shard.tokens().astype("<u4").tobytes()
                starts = shard.starts
                crc = [zlib.crc32(data[4 * lo:4 * hi]) for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + (ahead + before)), pa.array(np.diff(starts)),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per part: the write has as many parts as the session shuffles into
    placed = files.select("part", "before", "file").join(F.broadcast(_part_starts(files)), "part")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of a few documents: shards outside their range of ids are not read, other documents not decoded."""
    wanted = sorted(set(doc_ids))
    if not wanted:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    files = spark.read.parquet(path).filter((F.col("largest_id") >= wanted[0]) & (F.col("least_id") <= wanted[-1]))
    holds = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: i.between(F.col("least_id"), F.col("largest_id")))

    def run(batches):
        asked = set(wanted)
        for b in batches:
            for blob in b.column("file").to_pylist():
                shard = Shard(blob)
                at = [k for k, i in enumerate(shard.doc_ids) if i in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.doc_ids[k] for k in at], pa.int64()),
                     pa.array([shard.document(k).astype(np.int64).tolist() for k in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.filter(holds).select("file").mapInArrow(run, "doc_id long, ids array<long>")
