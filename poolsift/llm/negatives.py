"""Hard-negative mining by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions.  For an
anchor and a row the triangle inequality of angles bounds their angle from both
sides; the cosines of these bounds, multiplied by both norms and widened against
rounding, bound their inner product.  Only rows whose bounds meet a window of
wanted scores get an integer score.

Rows are packed into shards of one cell (the nearest reference direction), anchors
into blocks.  The same bounds on whole shards and blocks (smallest and largest
angle and norm) decide which block visits which shard, so a pair that cannot hold
a wanted score is never shipped.  The anchors are a stated query set against all
rows; their pairs with rows exist only as matrices inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, shuffle_parts

REFERENCES = 8
SAMPLE_ROWS = 1024           # the reference directions are chosen among so many rows (bounded; any choice is right)
SHARD_BYTES = 16 << 20       # of vectors that a task holds at once
BLOCK_BYTES = 256 << 10      # of one packed row
ANCHOR_ROWS = 256
SLOTS = 32                   # over which the join of shards and blocks is spread
LOW, HIGH = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)
TURN = 4e-6                  # radians by which angle bounds are widened: arccos of a rounded cosine near 1
EXACT = float(1 << 52)       # below, sums of products are exact in float64
PACKED = ("dim int, cell int, pack long, n int, lo array<double>, hi array<double>, short double, long double, "
          "want_lo double, want_hi double, payload binary")


def participants(vectors: DataFrame, id_col: str, label_col: Column | str, vec_col: str) -> DataFrame:
    """``__id, __label, __vec`` of the rows that take part (null ids among them)."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    finite = F.forall("__vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), label.cast("long").alias("__label"),
                          F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("__vec"))
    return rows.filter(F.col("__label").isNotNull() & F.col("__vec").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in float64, cut to the range of a long."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), float(LOW), float(HIGH))


def angles_to(x: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """(rows, references) of angles; a zero vector counts as orthogonal to all."""
    cos = (x / np.where(norm > 0, norm, 1.0)[:, None]) @ refs.T
    return np.arccos(np.clip(cos, -1.0, 1.0))


def score_bounds(a_angle, a_norm, b_angle, b_norm):
    """Lower and upper bounds of all inner products of a (rows) and b (columns)."""
    least = np.zeros((len(a_norm), len(b_norm)))
    most = np.full(least.shape, np.pi)
    for r in range(a_angle.shape[1]):
        t, p = a_angle[:, r][:, None], b_angle[:, r][None, :]
        np.maximum(least, np.abs(t - p), out=least)
        both = t + p
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    size = a_norm[:, None] * b_norm[None, :]
    slack = 1e-9 * size + 1.0
    lo = np.cos(np.minimum(most + TURN, np.pi)) * size - slack
    hi = np.cos(np.maximum(least - TURN, 0.0)) * size + slack
    return np.clip(lo, float(LOW), float(HIGH)), np.clip(hi, float(LOW), float(HIGH))


def integer_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of one whole-number vector with many; scores beyond a long are cut to its ends."""
    exact = np.abs(x).max(1, initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT
    out = np.zeros(len(x), np.int64)
    out[exact] = (x[exact] @ q).astype(np.int64)
    for i in np.nonzero(~exact)[0].tolist():
        out[i] = min(max(sum(int(a) * int(b) for a, b in zip(q.tolist(), x[i].tolist())), LOW), HIGH)
    return out


def reference_directions(rows: DataFrame, scale: float) -> dict:
    """Per vector length, unit vectors far apart from each other among a bounded sample of rows."""
    sample = rows.select("__vec").orderBy(F.xxhash64("__vec", "__id"), "__id").limit(SAMPLE_ROWS).collect()
    by: dict = {}
    for r in sample:
        by.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, vecs in by.items():
        x = whole(np.array(vecs, float).reshape(len(vecs), dim), scale)
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0][:, None]
        if not len(x):
            continue
        chosen = [0]
        near = x @ x[0]
        while len(chosen) < min(REFERENCES, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[dim] = x[chosen]
    return out


def references(of: dict, dim: int) -> np.ndarray:
    """Those of the sample, filled up with the axes (a length that the sample lacks has only these)."""
    refs = of.get(dim, np.zeros((0, dim)))
    more = np.zeros((REFERENCES - len(refs), dim))
    if dim:
        more[np.arange(len(more)), np.arange(len(more)) % dim] = 1.0
    return np.vstack([refs, more])


def _unpack(blob: bytes, n: int, dim: int) -> dict:
    """The arrays of a packed row; ``extra`` has as many columns as are left."""
    at = 0

    def take(kind, *shape):
        nonlocal at
        count = int(np.prod(shape))
        got = np.frombuffer(blob, kind, count, at).reshape(shape)
        at += 8 * count
        return got

    got = {"key": take(np.int64, n), "id": take(np.int64, n), "no_id": take(np.int64, n), "label": take(np.int64, n),
           "norm": take(np.float64, n), "angle": take(np.float64, n, REFERENCES), "x": take(np.float64, n, dim)}
    return got | {"extra": take(np.int64, n, (len(blob) - at) // 8 // n)}


def _pack(rows: DataFrame, of: dict, scale: float, parts: int, spread: int, most, extra: str | None = None) -> DataFrame:
    """Rows (``__key, __id, __label, __vec``) as packed rows of one vector length and one cell.

    ``most(dim)``: rows that share one ``pack`` (a shard or a block of anchors).
    ``extra``: a column of pairs of longs, the wanted score ranges of an anchor.
    """
    def place(batches):
        for b in batches:
            vecs = b.column("__vec").to_pylist()
            cell = np.zeros(len(vecs), np.int32)
            dims = np.array([len(v) for v in vecs], np.int32)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                x = whole(np.array([vecs[i] for i in at], float).reshape(len(at), dim), scale)
                cell[at] = angles_to(x, np.linalg.norm(x, axis=1), references(of, dim)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(cell)], names=[*b.schema.names, "dim", "cell"])

    def emit(pack, dim, cell, held):
        x = whole(np.array([r[3] for r in held], float).reshape(len(held), dim), scale)
        norm = np.linalg.norm(x, axis=1)
        angle = angles_to(x, norm, references(of, dim))
        ids = np.array([0 if r[1] is None else r[1] for r in held], np.int64)
        no_id = np.array([r[1] is None for r in held], np.int64)
        wanted = np.array([r[4] for r in held], np.int64).reshape(len(held), -1) if extra else np.zeros((len(held), 0), np.int64)
        open_ = wanted[:, 0::2] <= wanted[:, 1::2]
        lo = float(wanted[:, 0::2][open_].min()) if open_.any() else 1.0
        hi = float(wanted[:, 1::2][open_].max()) if open_.any() else 0.0
        arrays = [np.array([r[0] for r in held], np.int64), ids, no_id, np.array([r[2] for r in held], np.int64), norm, angle, x, wanted]
        step = max(1, BLOCK_BYTES // (8 * (dim + REFERENCES + 5 + wanted.shape[1])))
        for a in range(0, len(held), step):
            part = [c[a:a + step] for c in arrays]
            yield pa.RecordBatch.from_pylist([{
                "dim": dim, "cell": cell, "pack": pack, "n": len(part[0]), "lo": angle.min(0).tolist(), "hi": angle.max(0).tolist(),
                "short": float(norm.min()), "long": float(norm.max()), "want_lo": lo, "want_hi": hi,
                "payload": b"".join(np.ascontiguousarray(c).tobytes() for c in part)}], schema=ARROW)

    def run(batches):
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 32
        key, held = None, []
        for b in batches:
            for dim, cell, *row in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", *names))):
                if held and ((dim, cell) != key or len(held) >= most(dim)):
                    yield from emit(pack, *key, held)
                    pack += 1
                    held = []
                key = (dim, cell)
                held.append(row)
        if held:
            yield from emit(pack, *key, held)

    names = ["__key", "__id", "__label", "__vec"] + ([extra] if extra else [])
    schema = "__key long, __id long, __label long, __vec array<double>" + (f", {extra} array<long>" if extra else "")
    placed = rows.select(*names).mapInArrow(place, schema + ", dim int, cell int")
    return (placed.withColumn("sub", F.pmod(F.xxhash64("__key"), F.lit(spread))).repartition(parts, "dim", "cell", "sub")
            .sortWithinPartitions("dim", "cell", "sub", "__key").mapInArrow(run, PACKED))


ARROW = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()),
                   ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("short", pa.float64()), ("long", pa.float64()),
                   ("want_lo", pa.float64()), ("want_hi", pa.float64()), ("payload", pa.binary())])
SUMMARY = ["dim", "cell", "pack", "lo", "hi", "short", "long", "want_lo", "want_hi"]


def _may_meet() -> Column:
    """Whether a shard (s) can hold a score that a block of anchors (a) wants, by ``score_bounds`` of their extremes."""
    def c(side, name):
        return F.col(f"{side}.{name}")

    least = F.array_max(F.zip_with(F.zip_with(c("s", "lo"), c("a", "hi"), lambda x, y: x - y),
                                   F.zip_with(c("a", "lo"), c("s", "hi"), lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    two_pi = F.lit(2 * float(np.pi))
    most = F.array_min(F.zip_with(F.zip_with(c("s", "hi"), c("a", "hi"), lambda x, y: x + y),
                                  F.zip_with(c("s", "lo"), c("a", "lo"), lambda x, y: two_pi - (x + y)), lambda x, y: F.least(x, y)))
    # several pairs lie between these angles: the widest of all is bounded by the largest sums
    largest, smallest = c("s", "long") * c("a", "long"), c("s", "short") * c("a", "short")
    top = F.cos(F.greatest(least - TURN, F.lit(0.0)))
    low = F.cos(F.least(F.greatest(most, F.lit(0.0)) + TURN, F.lit(float(np.pi))))
    slack = largest * 1e-9 + 1.0
    hi = F.when(top >= 0, top * largest).otherwise(top * smallest) + slack
    lo = F.when(low >= 0, low * smallest).otherwise(low * largest) - slack
    ends = (F.lit(float(LOW)), F.lit(float(HIGH)))
    return (F.least(hi, ends[1]) >= c("a", "want_lo")) & (F.greatest(lo, ends[0]) <= c("a", "want_hi")) \
        & (c("a", "want_lo") <= c("a", "want_hi"))


def visits(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """``shard, block``: the pairs that can hold a wanted score."""
    s = shards.select(*SUMMARY).dropDuplicates(["pack"]).withColumn("slot", F.pmod("pack", F.lit(SLOTS)).cast("int")).alias("s")
    a = blocks.select(*SUMMARY).dropDuplicates(["pack"]).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).alias("a")
    met = s.join(a, (F.col("s.dim") == F.col("a.dim")) & (F.col("s.slot") == F.col("a.slot")) & _may_meet())
    return met.select(F.col("s.pack").alias("shard"), F.col("a.pack").alias("block"))


def _meet(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, score, schema: str, parts: int) -> DataFrame:
    """``score(anchors, rows)`` for every visit; a task holds one shard, the blocks pass by."""
    own = shards.select(F.col("pack").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "dim", "n", "payload")
    guests = pairs.join(blocks.select(F.col("pack").alias("block"), "dim", "n", "payload"), "block") \
        .select("shard", F.lit(1).alias("kind"), "block", "dim", "n", "payload")
    wanted = own.join(pairs.select("shard").distinct(), "shard", "left_semi")

    def run(batches):
        at, held, shard = None, [], None
        for b in batches:
            for s, kind, dim, n, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "dim", "n", "payload"))):
                if s != at:
                    at, held, shard = s, [], None
                if kind == 0:
                    held.append(_unpack(blob, n, dim))
                    continue
                if shard is None:
                    shard = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                    held = []
                yield from score(_unpack(blob, n, dim), shard)

    return (wanted.unionByName(guests).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "block").mapInArrow(run, schema))


def _ids(rows: dict, at: np.ndarray) -> pa.Array:
    return pa.array(rows["id"][at], pa.int64(), mask=rows["no_id"][at] != 0)


def _ordered(rows: dict, at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Order of rows ``at``: higher scores first, ties by smaller id, null ids last."""
    return np.lexsort((rows["id"][at], rows["no_id"][at], ~score))      # ~ turns the order without overflow


def _same_label(k: int):
    """Per anchor the k best rows of its label, itself among them (``own``)."""
    def score(anchors, rows):
        out = []
        hi = score_bounds(anchors["angle"], anchors["norm"], rows["angle"], rows["norm"])[1]
        for i in range(len(anchors["key"])):
            at = np.nonzero((rows["label"] == anchors["label"][i]) & (hi[i] >= anchors["extra"][i, 0]))[0]
            if not len(at):
                continue
            s = integer_scores(anchors["x"][i], rows["x"][at])
            first = _ordered(rows, at, s)[:k]
            at, s = at[first], s[first]
            same_id = (rows["no_id"][at] == anchors["no_id"][i]) & (rows["id"][at] == anchors["id"][i])
            own = same_id & (rows["x"][at] == anchors["x"][i]).all(1)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), anchors["key"][i])), _ids(rows, at), pa.array(s), pa.array(own)], names=["a", "id", "score", "own"]))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    return score


def _in_windows(k: int):
    """Per anchor and window the k best rows of other labels inside the window."""
    def score(anchors, rows):
        out = []
        lo, hi = score_bounds(anchors["angle"], anchors["norm"], rows["angle"], rows["norm"])
        for i in range(len(anchors["key"])):
            windows = anchors["extra"][i].reshape(-1, 2)
            may = np.zeros(len(rows["key"]), bool)
            for a, b in windows.tolist():
                if a <= b:
                    may |= (hi[i] >= a) & (lo[i] <= b)
            at = np.nonzero(may & (rows["label"] != anchors["label"][i]))[0]
            if not len(at):
                continue
            s = integer_scores(anchors["x"][i], rows["x"][at])
            inside = (s >= windows[windows[:, 0] <= windows[:, 1], 0].min()) & (s <= windows[windows[:, 0] <= windows[:, 1], 1].max())
            at, s = at[inside], s[inside]
            order = _ordered(rows, at, s)
            at, s = at[order], s[order]
            for w, (a, b) in enumerate(windows.tolist()):
                if a > b:
                    continue
                # scores fall: a window is one stretch
                first, end = np.searchsorted(~s, ~np.int64(b)), np.searchsorted(~s, ~np.int64(a), side="right")
                end = min(end, first + k)
                if end > first:
                    out.append(pa.RecordBatch.from_arrays(
                        [pa.array(np.full(end - first, anchors["key"][i])), pa.array(np.full(end - first, w + 1, np.int32)),
                         _ids(rows, at[first:end]), pa.array(s[first:end])], names=["a", "p", "id", "score"]))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    return score


def mine(vectors: DataFrame, anchor_filter: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", label_col: Column | str = "label", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that meet ``anchor_filter`` (a condition on ``__id``).  An
    anchor's positives are its ``positives`` best other rows of its label; for each,
    the first ``negatives`` rows of other labels with low * positive <= 100 *
    negative <= high * positive.  Scores are inner products of floor(scale * x);
    higher ones come first, ties by smaller id, null ids last.

    Rows with a null label, a null vector or a null or non-finite component take no
    part.  A row with a null id is a candidate and never an anchor.  Rows that
    repeat an id are rows of their own, as anchors too.  Vectors of different lengths have no
    score.  Components and scores beyond a long are cut to its ends.  An empty table
    gives no rows; other columns are not read.
    """
    spark = ready(vectors.sparkSession)
    rows = participants(vectors, id_col, label_col, vec_col)
    of = reference_directions(rows, scale)
    size = rows.agg(F.sum(F.lit(8) * F.size("__vec").cast("long")).alias("bytes")).first()["bytes"] or 0
    spread = max(1, -(-size // (REFERENCES * SHARD_BYTES)))
    parts = max(shuffle_parts(spark), 2 * REFERENCES * spread)

    def shard_rows(dim):
        return max(1, SHARD_BYTES // (8 * max(1, dim)))

    def block_rows(dim):
        return max(1, min(ANCHOR_ROWS, BLOCK_BYTES // (8 * (dim + REFERENCES + 5 + 2 * positives))))

    # the row's place in the stored table spreads equal rows over shards
    shards = _pack(rows.withColumn("__key", F.monotonically_increasing_id()), of, scale, parts, spread, shard_rows).checkpoint()
    # anchors that repeat a whole row are worked on once
    same = rows.filter(anchor_filter & F.col("__id").isNotNull()).groupBy("__id", "__label", "__vec").agg(F.count(F.lit(1)).alias("times"))
    anchors = same.withColumn("__key", F.monotonically_increasing_id()).checkpoint()

    def blocks(of_anchors: DataFrame) -> DataFrame:
        return _pack(of_anchors, of, scale, shuffle_parts(spark), 1 if size < SHARD_BYTES else spread, block_rows, "extra").checkpoint()

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("a").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= positives + 1)

    like = "a long, id long, score long, own boolean"
    # each block asks one shard of its cell first; the last score found there cuts the others
    asked = blocks(anchors.withColumn("extra", F.array(F.lit(LOW), F.lit(HIGH))))
    homes = shards.groupBy("dim", "cell").agg(F.min("pack").alias("shard"))
    home = asked.select("dim", "cell", F.col("pack").alias("block")).distinct().join(homes, ["dim", "cell"]).select("shard", "block")
    first = best(_meet(shards, asked, home, _same_label(positives + 1), like, parts)).checkpoint()
    floor = first.filter(F.col("r") == positives + 1).select(F.col("a").alias("__key"), F.col("score").alias("__floor"))
    again = blocks(anchors.join(floor, "__key", "left").withColumn(
        "extra", F.array(F.coalesce("__floor", F.lit(LOW)), F.lit(HIGH))))
    first = best(_meet(shards, again, visits(shards, again), _same_label(positives + 1), like, parts))
    # the anchor itself is one of its own rows: one of them goes
    mine_ = Window.partitionBy("a", "own").orderBy("r")
    in_order = Window.partitionBy("a").orderBy("r")
    positive = (first.withColumn("n_own", F.row_number().over(mine_)).filter(~(F.col("own") & (F.col("n_own") == 1)))
                .withColumn("p", F.row_number().over(in_order)).filter(F.col("p") <= positives)
                .select("a", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint())
    # 30 * p <= 100 * s <= 90 * p as a range of whole scores, without overflow
    wide = F.col("positive_score").cast("decimal(38,0)")
    window = F.struct("p", F.ceil(wide * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("lo"),
                      F.floor(wide * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(window)), lambda w: F.array(w["lo"], w["hi"])))
    missing = F.array_repeat(F.array(F.lit(1).cast("long"), F.lit(0).cast("long")), (F.lit(positives) - F.size("w") / 2).cast("int"))
    ranges = positive.groupBy("a").agg(flat.alias("w")).select(
        F.col("a").alias("__key"), F.concat("w", F.flatten(missing)).alias("extra"))
    hunting = blocks(anchors.join(ranges, "__key"))
    found = _meet(shards, hunting, visits(shards, hunting), _in_windows(negatives), "a long, p int, id long, score long", parts)
    w = Window.partitionBy("a", "p").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    out = ranked.join(positive, ["a", "p"]).join(anchors.select(F.col("__key").alias("a"), "__id", "times"), "a")
    # an anchor that repeats counts as often, in two steps of bounded arrays
    thousands = out.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 1) div 1024"))))
    return thousands.withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1024), F.expr("times - 1024 * t"))))).select(
        F.col("__id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
