"""Query strategies: base strategies, two-stage subpools, and the name registry.

Every strategy is DataFrame -> DataFrame.  The scored pool has
``uid, logits ARRAY<DOUBLE>, embedding ARRAY<...>``; results are the chosen
``uid`` rows.  Two-stage strategies first shrink the pool to a subpool
(random, SEALS neighbours, or anchored neighbours), then run the base
strategy on the subpool only -- the central saving of the method.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, as_doubles, dot, entropy, softmax
from ..session import cut_lineage
from .anchors import kmeans_rows, kmeanspp_pick, select_anchors
from .sampling import gumbel_top_k, hash_top_n, random_query, random_subset
from .similarity import knn_join

# ------------------------------------------------------------ base picks --


def entropy_scores(scored: DataFrame, logits: str = "logits") -> DataFrame:
    return scored.withColumn("entropy", entropy(logits))


def entropy_query(scored: DataFrame, q: int, uid: str = "uid", logits: str = "logits") -> DataFrame:
    """The q rows of highest predictive entropy (ties by uid)."""
    return (entropy_scores(scored, logits).orderBy(F.col("entropy").desc(), F.col(uid)).limit(q))


def kmeans_query(scored: DataFrame, q: int, seed: int = 42, uid: str = "uid",
                 vec: str = "embedding", max_iter: int = 20) -> DataFrame:
    """Row nearest each of q k-means centres."""
    rows = kmeans_rows(scored, q, seed=seed, uid=uid, vec=vec, max_iter=max_iter)
    return scored.join(rows.select(uid), on=uid, how="left_semi")


def badge_factors(scored: DataFrame, logits: str = "logits", vec: str = "embedding") -> DataFrame:
    """Gradient embedding factors: g = softmax(l) - onehot(argmax l), h = vec.

    The gradient vector is g (outer) h; we keep the two factors, never the
    classes x dims product.
    """
    p = softmax(logits)
    am = argmax(logits)
    g = F.transform(p, lambda x, i: x - F.when(i == am, F.lit(1.0)).otherwise(F.lit(0.0)))
    return scored.withColumn("g", g).withColumn("h", as_doubles(vec))


def badge_sqdist(row: Sequence[Column], center: Sequence[Column]) -> Column:
    """||g h^T - g' h'^T||^2 from factors: |g|^2|h|^2 + |g'|^2|h'|^2 - 2(g.g')(h.h')."""
    g, h = row
    gc, hc = center
    return F.greatest(dot(g, g) * dot(h, h) + dot(gc, gc) * dot(hc, hc) - F.lit(2.0) * dot(g, gc) * dot(h, hc),
                      F.lit(0.0))


def badge_gradient_norm(scored: DataFrame, logits: str = "logits", vec: str = "embedding") -> DataFrame:
    """Norm of the gradient embedding per row: ||g|| * ||h||."""
    f = badge_factors(scored, logits, vec)
    return f.withColumn("grad_norm", F.sqrt(dot("g", "g") * dot("h", "h"))).drop("g", "h")


def badge_query(scored: DataFrame, q: int, seed=42, uid: str = "uid", logits: str = "logits",
                vec: str = "embedding") -> DataFrame:
    f = badge_factors(scored, logits, vec).select(uid, "g", "h")
    picks = kmeanspp_pick(f, q, seed=seed, uid=uid, vec_cols=["g", "h"], metric="outer")
    return scored.join(picks.select(uid), on=uid, how="left_semi")


def tyrogue_query(scored: DataFrame, q: int, r_factor: int = 3, seed: int = 42, uid: str = "uid",
                  logits: str = "logits", vec: str = "embedding", max_iter: int = 20) -> DataFrame:
    """Diversity pick of r*q rows by k-means, then the q most uncertain of them."""
    diverse = kmeans_query(scored, r_factor * q, seed=seed, uid=uid, vec=vec, max_iter=max_iter)
    return entropy_query(diverse, q, uid=uid, logits=logits)


# ------------------------------------------------------------- subpools --


def anchor_subpool(candidates: DataFrame, size: int) -> DataFrame:
    """Mean distance per pool row over the anchors that retrieved it; top ``size``
    by score = 1 - mean distance (ties by uid)."""
    scores = candidates.groupBy("uid").agg(F.avg("dists").alias("mean_dist")) \
        .withColumn("scores", F.lit(1.0) - F.col("mean_dist")).drop("mean_dist")
    return scores.orderBy(F.col("scores").desc(), F.col("uid")).limit(size)


def anchor_subpool_sampled(candidates: DataFrame, size: int, seed=42, temperature: float = 1.0) -> DataFrame:
    """As ``anchor_subpool`` but sampled without replacement with p = softmax(score)."""
    scores = candidates.groupBy("uid").agg(F.avg("dists").alias("mean_dist")) \
        .withColumn("scores", F.lit(1.0) - F.col("mean_dist")).drop("mean_dist")
    return gumbel_top_k(scores, "scores", size, seed=seed, uid="uid", temperature=temperature)


def seals_subpool(labelled: DataFrame, pool: DataFrame, k: int, size: int, seed=42,
                  uid: str = "uid", vec: str = "embedding", max_search_size: int | None = None) -> DataFrame:
    """Union of the k nearest pool rows of every labelled row, capped by a hash sample."""
    cands = knn_join(labelled, pool, k=k, id_col=uid, vec_col=vec, max_search_size=max_search_size, seed=seed)
    ids = cands.select("uid").distinct()
    return hash_top_n(ids, size, uid="uid", seed=seed)


@dataclass
class TwoStageConfig:
    subpool_size: int = 10_000
    num_neighbours: int = 50
    num_anchors: int = 10
    anchor_strategy_minority: str = "kmeans_pp_sampling"
    anchor_strategy_majority: str = "kmeans_pp_sampling"
    minority_classes: list = field(default_factory=list)
    max_search_size: int | None = None
    temperature: float = 1.0
    seed: int = 42


def anchored_subpool(labelled: DataFrame, pool: DataFrame, cfg: TwoStageConfig, sampling: bool = False,
                     label: str = "label", uid: str = "uid", vec: str = "embedding",
                     logits: str = "logits", round_: int | None = None) -> DataFrame:
    anchors = select_anchors(labelled, cfg.num_anchors, cfg.anchor_strategy_minority,
                             cfg.anchor_strategy_majority, cfg.minority_classes, seed=cfg.seed,
                             label=label, uid=uid, logits=logits, vec=vec)
    cands = knn_join(anchors, pool, k=cfg.num_neighbours, id_col=uid, vec_col=vec,
                     max_search_size=cfg.max_search_size, seed=cfg.seed)
    if sampling:
        s = cfg.seed if round_ is None else f"{cfg.seed}:{round_}"
        return anchor_subpool_sampled(cands, cfg.subpool_size, seed=s, temperature=cfg.temperature)
    return anchor_subpool(cands, cfg.subpool_size)


# ------------------------------------------------------------- registry --

BASE_STRATEGIES = ("random", "entropy", "ftbertkm", "badge", "tyrogue")
STAGES = ("randomsubset", "seals", "anchored", "anchoredwithsampling")
STRATEGY_NAMES = tuple([f"{s}_{b}" for s in STAGES for b in BASE_STRATEGIES] + list(BASE_STRATEGIES))


def run_base(name: str, scored: DataFrame, q: int, seed=42, round_: int | None = None,
             uid: str = "uid") -> DataFrame:
    s = seed if round_ is None else f"{seed}:{round_}"
    if name == "random":
        return random_query(scored, q, seed=s, uid=uid)
    if name == "entropy":
        return entropy_query(scored, q, uid=uid)
    if name == "ftbertkm":
        return kmeans_query(scored, q, seed=int(seed), uid=uid)
    if name == "badge":
        return badge_query(scored, q, seed=s, uid=uid)
    if name == "tyrogue":
        return tyrogue_query(scored, q, seed=int(seed), uid=uid)
    raise ValueError(f"unknown base strategy {name}")


def subpool(stage: str, scored_pool: DataFrame, labelled: DataFrame, cfg: TwoStageConfig,
            round_: int | None = None, label: str = "label", uid: str = "uid") -> DataFrame:
    """First stage of a two-stage strategy: the subpool ids."""
    if stage == "randomsubset":
        return random_subset(scored_pool.select(uid), cfg.subpool_size, seed=cfg.seed, round_=round_, uid=uid)
    if stage == "seals":
        return seals_subpool(labelled, scored_pool, cfg.num_neighbours, cfg.subpool_size, seed=cfg.seed,
                             uid=uid, max_search_size=cfg.max_search_size)
    if stage in ("anchored", "anchoredwithsampling"):
        return anchored_subpool(labelled, scored_pool, cfg, sampling=stage == "anchoredwithsampling",
                                label=label, uid=uid, round_=round_)
    raise ValueError(f"unknown stage {stage}")


def run_strategy(name: str, scored_pool: DataFrame, labelled: DataFrame, q: int,
                 cfg: TwoStageConfig | None = None, round_: int | None = None,
                 label: str = "label", uid: str = "uid", subpools: dict | None = None) -> DataFrame:
    """Run a registered strategy by name: ``<stage>_<base>`` or a bare base name.

    ``subpools`` keeps each stage's scored subpool (checkpointed) for further calls
    with the same pool, labelled rows, configuration and round.
    """
    cfg = cfg or TwoStageConfig()
    if name in BASE_STRATEGIES:
        return run_base(name, scored_pool, q, cfg.seed, round_, uid)
    stage, base = name.split("_", 1)
    if stage not in STAGES or base not in BASE_STRATEGIES:
        raise ValueError(f"unknown strategy {name}")
    kept = subpools.get(stage) if subpools is not None else None
    if kept is None:
        sub = subpool(stage, scored_pool, labelled, cfg, round_, label, uid)
        kept = scored_pool.join(sub.select(uid), on=uid, how="left_semi")
        if subpools is not None:
            kept = subpools[stage] = cut_lineage(kept)
    return run_base(base, kept, q, cfg.seed, round_, uid)
