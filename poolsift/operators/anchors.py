"""Anchor selection per class, batched k-means++ picking, and k-means row picking.

k-means++ (D^2 sampling) is sequential: pick s is the row with the largest
``ln(d^2) + Gumbel(seed:s, uid)``, by the Gumbel-max trick exactly a draw with probability
proportional to d^2.  Squared distances to the nearest pick only fall, so a row's
key at an earlier state bounds its later keys from above.  One pass over the table
therefore serves many picks: it returns, for each of the next steps, the few rows
with the largest bounds; a step is settled as soon as the best true key among them
reaches the last bound, and otherwise waits for the next pass.  The picks are
those of one pass per pick.

k-means (Lloyd) runs all groups in one pass per iteration: tasks assign their rows
and send sums per centre.

Both keep the centres or picks on the driver and send them to the tasks; their
number is known beforehand, and groups are worked on in portions that
keep them below a budget of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.vectors import as_doubles, entropy
from ..session import cut_lineage
from .sampling import hash_top_n

ZERO_DISTANCE_PENALTY = 1e6
LOOK_AHEAD = 32              # picks that one pass may settle
CANDIDATES = 32              # rows with the largest bounds kept per step
STATE_BYTES = 64 << 20       # of picks, centres and candidates that a portion of groups may take on the driver
MOST_GUMBEL = 23.0           # of 32-bit uniforms: -ln(-ln(1 - 2^-33)) = 22.9


def top_n_by(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column],
             rank_col: str | None = None) -> DataFrame:
    """``row_number() <= n`` per group (planned with a partial WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


# ------------------------------------------------------------ numpy kernels --

def _matrix(col: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    col = col if at is None else col.take(pa.array(at))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def euclidean(rows: list[np.ndarray], centres: list[np.ndarray]) -> np.ndarray:
    """(rows, centres) of squared distances, from differences: equal vectors are exactly 0 apart."""
    return np.stack([((rows[0] - c) ** 2).sum(1) for c in centres[0]], axis=1)


def outer_products(rows: list[np.ndarray], centres: list[np.ndarray]) -> np.ndarray:
    """Squared distances of g (outer) h to g' (outer) h', from the factors."""
    (g, h), (gc, hc) = rows, centres
    size = ((g * g).sum(1) * (h * h).sum(1))[:, None] + ((gc * gc).sum(1) * (hc * hc).sum(1))[None, :]
    return np.maximum(size - 2.0 * (g @ gc.T) * (h @ hc.T), 0.0)


METRICS = {"euclidean": euclidean, "outer": outer_products}


def gumbel_of(seed, uids: list) -> np.ndarray:
    """``functions.hashing.gumbel`` of many ids."""
    head = f"{seed}:"
    u = np.array([int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in uids], np.float64)
    return -np.log(-np.log((u + 0.5) / 4294967296.0))


def _keys(d2: np.ndarray, g: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(np.isnan(d2), g, np.where(d2 > 0, np.log(np.where(d2 > 0, d2, 1.0)) + g, g - ZERO_DISTANCE_PENALTY))


def _groups(batch: pa.RecordBatch, by: Sequence[str]):
    """(group, places) of a batch's rows."""
    if not by:
        yield (), np.arange(batch.num_rows)
        return
    of: dict = {}
    for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by))):
        of.setdefault(key, []).append(i)
    for key, at in of.items():
        yield key, np.array(at)


def _portions(base: DataFrame, by: Sequence[str], bytes_a_group: int):
    """The table, or its groups in portions whose state fits ``STATE_BYTES``."""
    groups = base.select(*by).distinct().count() if by else 1
    n = max(1, min(groups, -(-groups * bytes_a_group // STATE_BYTES))) if by else 1
    for i in range(n):
        yield base if n == 1 else base.filter(F.pmod(F.xxhash64(*by), F.lit(n)) == i)


# --------------------------------------------------------------- k-means++ --

def _bounds(base: DataFrame, by, vec_cols, metric, seed, picked: dict, steps: range) -> DataFrame:
    """Per group and step the ``CANDIDATES`` rows with the largest keys at the present state."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in by]
                       + ["__step int", "uid long", "__d2 double", "__g double", "__key double"] + [f"`{c}` array<double>" for c in vec_cols])

    def run(batches):
        best: dict = {}          # (group, step) -> [uids, d2, g, key, vectors...], at most CANDIDATES rows
        for b in batches:
            for group, at in _groups(b, by):
                uids = np.array(b.column("uid").to_pylist(), np.int64)[at]
                done = picked.get(group)
                d2 = np.full(len(at), np.nan)
                vecs = [_matrix(b.column(c), at) for c in vec_cols]
                if done is not None:
                    d2 = metric(vecs, done[1]).min(1)
                    free = ~np.isin(uids, done[0])
                    uids, d2, vecs = uids[free], d2[free], [v[free] for v in vecs]
                least_log = _keys(d2, np.zeros(len(d2)))
                for s in steps:
                    held = best.get((group, s))
                    # rows whose key cannot reach the last one kept are not hashed
                    may = np.arange(len(uids)) if held is None or len(held[0]) < CANDIDATES else \
                        np.nonzero(least_log + MOST_GUMBEL >= held[3][-1])[0]
                    if not len(may):
                        continue
                    g = gumbel_of(f"{seed}:{s}", uids[may].tolist())
                    new = [uids[may], d2[may], g, _keys(d2[may], g), *(v[may] for v in vecs)]
                    if held is not None:
                        new = [np.concatenate([x, y]) for x, y in zip(held, new)]
                    first = np.lexsort((new[0], -new[3]))[:CANDIDATES]
                    best[group, s] = [x[first] for x in new]
        for (group, s), (uids, d2, g, key, *vecs) in best.items():
            n = len(uids)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x] * n, base_types[c]) for c, x in zip(by, group)), pa.array(np.full(n, s, np.int32)), pa.array(uids),
                     pa.array([None if np.isnan(x) else x for x in d2], pa.float64()), pa.array(g), pa.array(key),
                     *(pa.array(v.tolist(), pa.list_(pa.float64())) for v in vecs)],
                    names=[*by, "__step", "uid", "__d2", "__g", "__key", *vec_cols])

    from pyspark.sql.pandas.types import to_arrow_type
    base_types = {c: to_arrow_type(base.schema[c].dataType) for c in by}
    found = base.mapInArrow(run, schema)
    return top_n_by(found, CANDIDATES, [*by, "__step"], [F.desc("__key"), F.asc("uid")])


def _settled(rows: list, vec_cols, metric) -> tuple | None:
    """(uid, vectors) of the picks of consecutive steps that the candidates of one group settle."""
    by_step: dict = {}
    for r in rows:
        by_step.setdefault(r["__step"], []).append(r)
    picks, places = [], []
    for s in sorted(by_step):
        cand = sorted(by_step[s], key=lambda r: (-r["__key"], r["uid"]))
        last = cand[-1] if len(cand) == CANDIDATES else None
        cand = [r for r in cand if r["uid"] not in picks]
        if not cand:
            break
        d2 = np.array([np.nan if r["__d2"] is None else r["__d2"] for r in cand])
        if places:
            vecs = [np.array([r[c] for r in cand]) for c in vec_cols]
            near = metric(vecs, [np.array([p[c] for p in places]) for c in vec_cols]).min(1)
            d2 = np.fmin(d2, near)
        key = _keys(d2, np.array([r["__g"] for r in cand]))
        i = min(range(len(cand)), key=lambda j: (-key[j], cand[j]["uid"]))
        # a row that is no candidate has a smaller bound than the last one
        if last is not None and (-key[i], cand[i]["uid"]) > (-last["__key"], last["uid"]):
            break
        picks.append(cand[i]["uid"])
        places.append(cand[i])
    return picks, [[p[c] for p in places] for c in vec_cols]


def kmeanspp_pick(df: DataFrame, k: int, seed=42, by: Sequence[str] = (), uid: str = "uid",
                  vec_cols: Sequence[str] = ("vec",), metric: str = "euclidean", passes: list | None = None) -> DataFrame:
    """k-means++ seeding picks: returns ``by..., uid, pick_step`` (k rows per group,
    or the whole group when it has at most k rows).

    Rows with a null vector take no part.  Equal keys fall to the smaller uid.
    ``passes`` collects the steps settled by each pass over the table.
    """
    by, vec_cols = list(by), list(vec_cols)
    spark = df.sparkSession
    base = df.select(*by, F.col(uid).cast("long").alias("uid"), *[as_doubles(c).alias(c) for c in vec_cols])
    base = cut_lineage(base.dropna(subset=vec_cols))
    far = METRICS[metric]
    width = base.select(sum((F.size(c) for c in vec_cols), F.lit(0)).alias("w")).agg(F.max("w")).first()[0] or 0
    out = []
    ahead = min(LOOK_AHEAD, k)
    for part in _portions(base, by, 8 * (width + 8) * (k + ahead * CANDIDATES)):
        picked: dict = {}
        open_groups = None
        step = 0
        while step < k:
            # without a pick there is no distance that bounds later keys
            steps = range(step, min(step + ahead, k) if step else 1)
            rows: dict = {}
            for r in _bounds(part, by, vec_cols, far, seed, picked, steps).collect():
                rows.setdefault(tuple(r[c] for c in by), []).append(r)
            found = {g: _settled(r, vec_cols, far) for g, r in rows.items()}
            open_groups = {g for g, (ids, _) in found.items() if ids}
            if not open_groups:
                break
            # all groups go on from the same step; a group that ran out of rows holds nobody up
            whole = {g for g, r in rows.items() if len({x["uid"] for x in r}) <= len(found[g][0])}
            ready_ = min((len(found[g][0]) for g in open_groups - whole), default=len(steps))
            for g in open_groups:
                ids, vecs = found[g]
                ids, vecs = ids[:ready_], [np.array(v[:ready_], np.float64) for v in vecs]
                out += [(*g, i, step + n) for n, i in enumerate(ids)]
                old = picked.get(g)
                picked[g] = (np.array(ids), vecs) if old is None else \
                    (np.concatenate([old[0], ids]), [np.vstack([x, y]) for x, y in zip(old[1], vecs)])
            if passes is not None:
                passes.append(ready_)
            step += ready_
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in by] + [f"`{uid}` long", "pick_step int"])
    return spark.createDataFrame(out, schema)


# ----------------------------------------------------------------- k-means --

def _assign(base: DataFrame, by, centres: dict) -> DataFrame:
    """Rows with ``cluster`` (the nearest centre of the group, ties to the lower number) and ``__d2``."""
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["cluster int", "__d2 double"])

    def run(batches):
        for b in batches:
            cluster, d2 = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for group, at in _groups(b, by):
                far = euclidean([_matrix(b.column("vec"), at)], [centres[group]])
                cluster[at] = far.argmin(1)
                d2[at] = far[np.arange(len(at)), cluster[at]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(d2)], names=[*b.schema.names, "cluster", "__d2"])

    return base.mapInArrow(run, types)


def _update(base: DataFrame, by, centres: dict, k: int) -> dict:
    """Means of the assigned rows; an empty centre moves to a row far from its own centre.

    The m-th empty centre of a group takes the row with the m-th largest distance
    (ties to the smaller uid); rows that lie on a centre are not taken.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    types = {c: to_arrow_type(base.schema[c].dataType) for c in by}
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in by]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sums: dict = {}
        away: dict = {}
        for b in batches:
            for group, at in _groups(b, by):
                v, c = _matrix(b.column("vec"), at), centres[group]
                far = euclidean([v], [c])
                near = far.argmin(1)
                total, n = sums.get(group, (np.zeros_like(c), np.zeros(len(c), np.int64)))
                total = total.copy()
                np.add.at(total, near, v)
                sums[group] = (total, n + np.bincount(near, minlength=len(c)))
                d2 = far[np.arange(len(at)), near]
                uids = np.array(b.column("uid").to_pylist(), np.int64)[at]
                out = d2 > 0
                held = [d2[out], uids[out], v[out]]
                if group in away:
                    held = [np.concatenate([x, y]) for x, y in zip(away[group], held)]
                first = np.lexsort((held[1], -held[0]))[:k]
                away[group] = [x[first] for x in held]
        for kind, items in ((0, sums), (1, away)):
            for group, state in items.items():
                if kind == 0:
                    which = np.nonzero(state[1])[0]
                    parts = [which.tolist(), state[1][which].astype(float).tolist(), state[0][which].tolist()]
                else:
                    parts = [state[1].tolist(), state[0].tolist(), state[2].tolist()]
                n = len(parts[0])
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x] * n, types[c]) for c, x in zip(by, group)), pa.array([task] * n, pa.int32()), pa.array([kind] * n, pa.int32()),
                         pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.float64()), pa.array(parts[2], pa.list_(pa.float64()))],
                        names=[*by, "__task", "__kind", "__at", "__n", "__v"])

    sent = base.mapInArrow(run, ", ".join([*keys, "__task int", "__kind int", "__at long", "__n double", "__v array<double>"]))

    # sums of one centre meet in one task, in the order of the tasks that sent them (the same at every run)
    def add(batches):
        held, key = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], types[c]) for c, x in zip(by, key)), pa.array([key[-1]], pa.int64()), pa.array([held[0]]),
                 pa.array([held[1].tolist()], pa.list_(pa.float64()))], names=[*by, "__at", "__n", "__v"])

        for b in batches:
            for *group, at, n, v in zip(*(b.column(c).to_pylist() for c in [*by, "__at", "__n", "__v"])):
                now = (*group, at)
                if held is not None and now != key:
                    yield out()
                    held = None
                key = now
                held = (n, np.array(v)) if held is None else (held[0] + n, held[1] + np.array(v))
        if held is not None:
            yield out()

    sent = cut_lineage(sent)
    sums = sent.filter("__kind = 0").repartition(*by, "__at").sortWithinPartitions(*by, "__at", "__task") \
        .select(*by, "__at", "__n", "__v").mapInArrow(add, ", ".join([*keys, "__at long", "__n double", "__v array<double>"]))
    new = {g: c.copy() for g, c in centres.items()}
    full = {g: set() for g in centres}
    for r in sums.collect():
        g = tuple(r[c] for c in by)
        new[g][r["__at"]] = np.array(r["__v"]) / r["__n"]
        full[g].add(r["__at"])
    if any(len(full[g]) < len(c) for g, c in centres.items()):
        far: dict = {}
        for r in top_n_by(sent.filter("__kind = 1"), k, by, [F.desc("__n"), F.asc("__at")], rank_col="__m").collect():
            far.setdefault(tuple(r[c] for c in by), {})[r["__m"]] = r["__v"]
        for g, c in new.items():
            for m, i in enumerate(sorted(set(range(len(c))) - full[g])):
                if m + 1 in far.get(g, {}):
                    c[i] = far[g][m + 1]
    return new


def lloyd(df: DataFrame, k: int, by: Sequence[str] = (), seed=42, uid: str = "uid", vec: str = "vec", max_iter: int = 20) -> DataFrame:
    """k-means of every group at once: ``by..., uid, cluster, d2`` (squared distance to the centre).

    Centres start at the k first rows of a group in hash order, ``md5(seed:uid)`` then
    uid (all rows of a smaller group).  An iteration assigns rows to the nearest centre,
    ties to the lower number, and moves centres to the means; empty ones are refilled
    (``_update``).  Ends when no centre moves or after ``max_iter`` iterations.  Rows with a null
    vector take no part; vectors have one length.
    """
    by = list(by)
    base = df.select(*by, F.col(uid).cast("long").alias("uid"), as_doubles(vec).alias("vec")).dropna(subset=["vec"])
    base = cut_lineage(base)
    width = base.agg(F.max(F.size("vec"))).first()[0] or 0
    outs = []
    for part in _portions(base, by, 8 * (width + 4) * 2 * k):
        first = top_n_by(part, k, by, [order_key(seed, "uid"), F.col("uid")], rank_col="__c") if by else \
            part.orderBy(order_key(seed, "uid"), "uid").limit(k).withColumn("__c", F.row_number().over(Window.orderBy(order_key(seed, "uid"), "uid")))
        centres: dict = {}
        for r in sorted(first.collect(), key=lambda r: r["__c"]):
            centres.setdefault(tuple(r[c] for c in by), []).append(r["vec"])
        centres = {g: np.array(c, np.float64) for g, c in centres.items()}
        if not centres:
            continue
        for _ in range(max_iter):
            new = _update(part, by, centres, k)
            still = all(np.array_equal(new[g], centres[g]) for g in centres)
            centres = new
            if still:
                break
        outs.append(_assign(part, by, centres))
    out = outs[0] if outs else base.withColumn("cluster", F.lit(0)).withColumn("__d2", F.lit(0.0))
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.select(*by, F.col("uid").alias(uid), "cluster", F.col("__d2").alias("d2"))


def kmeans_rows(df: DataFrame, k: int, seed: int = 42, uid: str = "uid", vec: str = "vec",
                max_iter: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The row nearest each of k centres (``lloyd``; ties by uid): ``by..., uid, cluster``.

    Where centres coincide or stay empty, the rows next nearest to any centre fill
    up, so min(k, rows) distinct rows are returned per group.
    """
    by = list(by)
    rows = cut_lineage(lloyd(df, k, by, seed, uid, vec, max_iter))
    best = rows.groupBy(*by, "cluster").agg(F.min(F.struct("d2", uid)).alias("b")).select(
        *by, "cluster", "b.*", F.lit(0).alias("__r"))
    # each best row may be among the nearest, so twice as many are enough
    nearest = rows.orderBy("d2", uid).limit(2 * k) if not by else top_n_by(rows, 2 * k, by, [F.col("d2"), F.col(uid)])
    both = best.unionByName(nearest.withColumn("__r", F.lit(1))).groupBy(*by, uid).agg(
        F.min("__r").alias("__r"), F.min("cluster").alias("cluster"), F.min("d2").alias("d2"))
    return top_n_by(both, k, by, [F.col("__r"), F.col("d2"), F.col(uid)]).select(*by, uid, "cluster")


# ----------------------------------------------------------------- anchors --

def anchors_random(labelled: DataFrame, num_anchors: int, seed=42, label: str = "label",
                   uid: str = "uid") -> DataFrame:
    return hash_top_n(labelled, num_anchors, uid=uid, seed=seed, by=[label])


def anchors_entropy(scored: DataFrame, num_anchors: int, label: str = "label", uid: str = "uid",
                    logits: str = "logits") -> DataFrame:
    """Most uncertain rows per class (entropy desc, uid); small classes whole."""
    return top_n_by(scored.withColumn("__h", entropy(logits)), num_anchors, [label],
                    [F.col("__h").desc(), F.col(uid)]).drop("__h")


def anchors_kmeanspp(labelled: DataFrame, num_anchors: int, seed=42, label: str = "label",
                     uid: str = "uid", vec: str = "embedding") -> DataFrame:
    base = labelled.select(label, uid, as_doubles(vec).alias("vec"))
    picks = kmeanspp_pick(base, num_anchors, seed=seed, by=[label], uid=uid, vec_cols=["vec"])
    return labelled.join(picks.select(label, uid), on=[label, uid], how="left_semi")


def anchors_kmeans(labelled: DataFrame, num_anchors: int, seed: int = 42, label: str = "label",
                   uid: str = "uid", vec: str = "embedding", max_iter: int = 20) -> DataFrame:
    """k-means anchors per class, all classes in one run; a class of at most ``num_anchors`` rows is returned whole."""
    rows = kmeans_rows(labelled, num_anchors, seed=seed, uid=uid, vec=vec, max_iter=max_iter, by=[label])
    return labelled.join(rows.select(label, uid), on=[label, uid], how="left_semi")


def anchors_all(labelled: DataFrame) -> DataFrame:
    return labelled


ANCHOR_METHODS = ("random", "entropy", "kmeans_sampling", "kmeans_pp_sampling", "all")


def _apply_method(method: str, rows: DataFrame, num_anchors: int, seed, label: str, uid: str,
                  logits: str, vec: str) -> DataFrame:
    if method == "all":
        return rows
    if method == "random":
        return anchors_random(rows, num_anchors, seed, label, uid)
    if method == "entropy":
        return anchors_entropy(rows, num_anchors, label, uid, logits)
    if method == "kmeans_pp_sampling":
        return anchors_kmeanspp(rows, num_anchors, seed, label, uid, vec)
    if method == "kmeans_sampling":
        return anchors_kmeans(rows, num_anchors, seed, label, uid, vec)
    raise ValueError(f"unknown anchor method {method}")


def select_anchors(labelled: DataFrame, num_anchors: int, minority_method: str = "random",
                   majority_method: str = "random", minority_classes: Sequence | None = None,
                   seed=42, label: str = "label", uid: str = "uid", logits: str = "logits",
                   vec: str = "embedding") -> DataFrame:
    """Anchors over all classes of the labelled set.

    Whole labelled set if it is empty or smaller than ``num_anchors``; within
    a class, the whole class if it has fewer than ``num_anchors`` rows;
    otherwise minority classes use ``minority_method``, the rest
    ``majority_method``.
    """
    minority = list(minority_classes or [])
    total = labelled.count()
    if total == 0 or (num_anchors > 0 and total < num_anchors):
        return labelled
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    sized = labelled.join(sizes, on=label, how="inner")
    small = sized.filter(F.col("__n") < num_anchors).drop("__n")
    big = sized.filter(F.col("__n") >= num_anchors).drop("__n")
    is_min = F.col(label).isin(minority) if minority else F.lit(False)
    parts = [small]
    methods = {minority_method: is_min, majority_method: ~is_min}
    if minority_method == majority_method:
        methods = {minority_method: F.lit(True)}
    for method, cond in methods.items():
        parts.append(_apply_method(method, big.filter(cond), num_anchors, seed, label, uid, logits, vec))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
