"""The active-learning round loop and the stand-in text encoder.

The loop runs on the driver (it is sequential by nature: each round depends on the
last), but every step inside is a distributed DataFrame plan.

Its state is a folder that driver and executors share.  A round writes the rows it
labelled under ``picks/round=<r>`` and then one row under ``commits/round=<r>``; Spark's
``_SUCCESS`` file of the latter commits it.  A round without a commit did not
happen: it is overwritten.  Rounds follow from the committed ones alone (all
sampling is keyed by seed, round and id), so a loop that is started again on the
folder of a killed one goes on behind its last commit and ends with the same log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import committed, shared_path
from .scorers import Scorer, logistic_scorer
from .strategies import TwoStageConfig, run_strategy

BROADCAST_IDS = 4_000_000      # labelled ids that are broadcast (16 bytes each, 64 MB); beyond, the join shuffles


class RoundStore:
    """Committed rounds of labelled rows under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, round_: int) -> str:
        return f"{self.folder}/{kind}/round={round_}"

    def last(self) -> int | None:
        """The last committed round (the initial set is round -1), or None."""
        r = -1
        while committed(self.spark, self._path("commits", r)):
            r += 1
        return None if r == -1 else r - 1

    def commit(self, round_: int, rows: DataFrame, settings: str) -> int:
        """Write a round's rows and commit them; returns how many there are."""
        rows.withColumn("labelling_round", F.lit(round_)).write.mode("overwrite").parquet(self._path("picks", round_))
        n = self.spark.read.parquet(self._path("picks", round_)).count()
        one = self.spark.createDataFrame([(n, settings)], "n long, settings string").coalesce(1)
        one.write.mode("overwrite").parquet(self._path("commits", round_))
        return n

    def manifest(self, last: int) -> list[tuple[int, str]]:
        """(rows, settings) of the rounds up to ``last``."""
        paths = [self._path("commits", r) for r in range(-1, last + 1)]
        rows = self.spark.read.option("basePath", f"{self.folder}/commits").parquet(*paths).collect()
        return [(r["n"], r["settings"]) for r in sorted(rows, key=lambda r: r["round"])]

    def labelled(self, last: int) -> DataFrame:
        """All labelled rows up to a round, with their ``labelling_round``."""
        return self.spark.read.parquet(*[self._path("picks", r) for r in range(-1, last + 1)])


def run_rounds(base: DataFrame, initial: DataFrame, strategy: str, budget: int, batch: int = 25, folder: str | None = None,
               cfg: TwoStageConfig | None = None, scorer: Scorer | None = None, label: str = "label", uid: str = "uid",
               vec: str = "embedding", after_write: Callable[[int], None] | None = None) -> DataFrame:
    """Label rows until ``budget`` rows are labelled or the pool is used up: ``uid, label, vec, labelling_round``.

    Every round fits the scorer on the labelled rows, scores the pool, selects ``batch``
    rows (fewer in the last round) with ``strategy`` and commits them.  ``initial`` is round
    -1.  Given the ``folder`` of an earlier run it resumes there; it refuses a
    folder that was begun with other settings.  ``after_write`` is called before each round.
    """
    spark = base.sparkSession
    cfg = cfg or TwoStageConfig()
    fit = scorer or logistic_scorer(label, vec)
    store = RoundStore(spark, folder or shared_path(spark, "rounds"))
    base = base.select(uid, label, vec)
    settings = f"{strategy} batch={batch} {cfg}"
    last = store.last()
    if last is None:
        total = store.commit(-1, initial.select(uid, label, vec), settings)
        last = -1
    else:
        done = store.manifest(last)
        if {s for _, s in done} != {settings}:
            raise ValueError(f"{store.folder} was begun with other settings")
        total = sum(n for n, _ in done)
    while total < budget:
        if after_write:
            after_write(last)
        labelled = store.labelled(last)
        ids = labelled.select(uid)
        # the pool stays where it is: the labelled ids come to it
        pool = base.join(F.broadcast(ids) if total <= BROADCAST_IDS else ids, uid, "left_anti")
        score = fit(labelled)
        picks = run_strategy(strategy, score(pool), score(labelled), min(batch, budget - total), cfg, round_=last + 1, label=label, uid=uid)
        n = store.commit(last + 1, picks.select(uid, label, vec), settings)
        last, total = last + 1, total + n
        if n == 0:
            break
    return store.labelled(last)


def round_log(labelled: DataFrame, base_rows: int, num_classes: int, label: str = "label") -> DataFrame:
    """Per round and class (zero rows included): ``labelling_round, class_id, count, cumulative_count, labelled_size, pool_size``.

    Sizes are those after the round's rows were labelled.
    """
    spark = labelled.sparkSession
    counts = labelled.groupBy("labelling_round", F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    classes = spark.range(num_classes).select(F.col("id").cast("int").alias("class_id"))
    every = F.array(*[F.lit(i) for i in range(num_classes)])
    grid = counts.select("labelling_round").distinct().withColumn("class_id", F.explode(every)) if num_classes else classes.limit(0)
    full = grid.join(counts, ["labelling_round", "class_id"], "left").withColumn("count", F.coalesce("n", F.lit(0).cast("long")))
    # small tables: rounds x classes rows
    up_to = Window.partitionBy("class_id").orderBy("labelling_round").rowsBetween(Window.unboundedPreceding, 0)
    sizes = Window.partitionBy("labelling_round")
    out = full.withColumn("cumulative_count", F.sum("count").over(up_to)).withColumn("labelled_size", F.sum("cumulative_count").over(sizes))
    return out.select("labelling_round", "class_id", "count", "cumulative_count", "labelled_size",
                      (F.lit(base_rows) - F.col("labelled_size")).alias("pool_size"))


def active_rounds(base: DataFrame, initial: DataFrame, strategy: str, rounds: int = 3, batch: int = 25,
                  cfg: TwoStageConfig | None = None, label: str = "label", uid: str = "uid",
                  vec: str = "embedding", model_factory=None) -> DataFrame:
    """``rounds`` rounds of ``batch`` rows with an MLlib model: the label log ``uid, labelling_round``."""
    budget = initial.count() + rounds * batch
    out = run_rounds(base, initial, strategy, budget, batch, cfg=cfg, scorer=logistic_scorer(label, vec, model_factory), label=label, uid=uid, vec=vec)
    return out.select(uid, "labelling_round")


def hash_embed(docs: DataFrame, text: str, dim: int = 64, id_col: str = "uid") -> DataFrame:
    """Hashed bag of words of the whole text, L2-normalised, as ``ARRAY<DOUBLE>``.

    A word's coordinate is the first 32 bits of its md5 modulo ``dim``; a text
    without words is the zero vector.  A native (JVM) stand-in for a sentence
    encoder; a real encoder would be ``embed_batches``.
    """
    words = docs.select(id_col, F.explode_outer(tokens(text)).alias("__tok"))
    bucket = F.conv(F.substring(F.md5("__tok"), 1, 8), 16, 10).cast("long") % F.lit(dim)
    counts = words.groupBy(id_col, bucket.alias("__b")).agg(F.count("__tok").alias("__n"))
    # at most ``dim`` entries per document
    entries = F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__n")))
    bags = counts.groupBy(id_col).agg(F.map_from_entries(entries).alias("__m"), F.sqrt(F.sum(F.col("__n") * F.col("__n"))).alias("__l"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
                     lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0)) / F.greatest("__l", F.lit(1.0)))
    return bags.select(id_col, at.alias("embedding"))


def length_sorted(df: DataFrame, length: str, uid: str = "uid", partitions: int | None = None) -> DataFrame:
    """Range-partition by length and sort inside partitions, so each inference
    batch holds texts of similar length (little padding)."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, length, uid).sortWithinPartitions(length, uid)


def embed_batches(docs: DataFrame, text: str, encode, dim: int, id_col: str = "uid") -> DataFrame:
    """Pluggable encoder over Arrow batches: ``encode(list[str]) -> ndarray (n, dim)``.

    Rows are length-sorted first; each task encodes its own batches, so the
    encoder (for example an ONNX session) is loaded once per Python worker.
    """
    import numpy as np

    sized = length_sorted(docs.select(id_col, text, F.length(text).alias("__len")), "__len", id_col)

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(encode(pdf[text].tolist()), dtype=np.float64).reshape(len(pdf), dim)
            yield pdf[[id_col]].assign(embedding=list(vecs))

    return sized.select(id_col, text).mapInPandas(run, f"{id_col} long, embedding array<double>")
