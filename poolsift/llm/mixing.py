"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table predicts every document's posterior
over the domains.  Document rates w >= 0 are then fitted by projected-gradient
least squares, so that the expected token totals of the domains,
``sum_i w_i * tokens_i * posterior_i``, match the targets.  The gradient with
respect to a document is a combination of its few posteriors; each step therefore
is one aggregation of domain-sized sums, and a document's rate follows from its
posteriors and the short list of steps.  No rate ever reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import own_names, plain_names, ready, shuffle_parts, slices, utf8
from .shingles import K, first_bytes, lower_ascii, mix as mixed_bits, span_hashes, word_spans

DOMAINS = ("clean", "low", "toxic")
#: token totals to reach, as multiples of what the corpus holds of each domain
TARGETS = {"clean": 1.25, "low": 0.5, "toxic": 0.0}
TRAIN_ROWS = 20_000      # bound of the labelled sample that the classifier is fitted on
FEATURES = 1 << 17
SMOOTHING = 0.5
CHI2 = 25.0              # one degree of freedom; features below are taken for chance
MIN_DOCS = 5
RIDGE = 1e-3
ITERATIONS = 50
STEPS = 20
HALVINGS = 6
TOLERANCE = 1e-3     # distance to the targets, as a share of all tokens, at which the fit ends
ADDED = ("__tokens", "__p", "__rate", "__copies")
KEEP = "clean"           # documents whose likeliest domain this is keep a rate of 1 at least


def label_domain() -> Column:
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean"))


def _features(batch: pa.RecordBatch):
    """Row and hashed feature of everything that a word shows, and the words per row.

    A word shows itself without the punctuation around it, its first four and
    first five bytes, and the punctuation at its end; a text shows how often it
    repeats words, in tenths.
    """
    data, off = utf8(batch.column("__text"))
    data = lower_ascii(data)
    start, end = word_spans(data, off)
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    place = np.arange(len(data), dtype=np.int64)
    plain = ~_punctuation()[data]
    before = np.maximum.accumulate(np.where(plain, place, -1)) if len(data) else place       # last plain byte up to here
    after = np.minimum.accumulate(np.where(plain, place, len(data))[::-1])[::-1] if len(data) else place
    first, last = np.maximum(start, after[start]) if len(start) else start, end
    last = before[end - 1] + 1 if len(end) else end
    bare = last <= first                       # nothing but punctuation: the word shows itself
    first, last = np.where(bare, start, first), np.where(bare, end, last)
    word = span_hashes(data, first, last)
    head, length = first_bytes(data, first), (last - first).astype(np.uint64)
    shows = [word] + [mixed_bits((head & ((K(1) << (K(8) * np.minimum(length, K(n)))) - K(1))) + K(n)) for n in (4, 5)]
    tail = np.nonzero(last < end)[0]
    shows.append(span_hashes(data, last[tail], end[tail]) + K(9))
    key = np.sort((doc.astype(np.uint64) << K(40)) | (word >> K(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    kinds = np.bincount((key[new] >> K(40)).astype(np.int64), minlength=len(counts))
    tenth = mixed_bits((10 * kinds // np.maximum(counts, 1)).astype(np.uint64) + K(77))
    feature = np.concatenate([*shows, tenth]) & K(FEATURES - 1)
    return np.concatenate([doc, doc, doc, doc[tail], np.arange(len(counts))]), feature.astype(np.int64), counts


def _punctuation() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    return t


def _once(doc: np.ndarray, feature: np.ndarray):
    key = np.unique(doc * FEATURES + feature)
    return key // FEATURES, key % FEATURES


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   most: int = TRAIN_ROWS) -> dict:
    """Logistic regression over which hashed features occur in whole texts of labelled documents.

    At most about ``most`` labelled ids, chosen by hash, take part (a stated
    bound); labels with null ids or values and ids without a document teach nothing.
    """
    spark = ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("__id"), label_domain().alias("domain")) \
        .filter(F.col("__id").isNotNull() & F.col("domain").isNotNull()).groupBy("__id").agg(F.max("domain").alias("domain"))
    share = min(1.0, most / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # bounded by ``most``: broadcast, the documents stay where they are
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")) \
        .join(F.broadcast(sample), "__id").select("domain", "__text")
    names = list(DOMAINS)

    def run(batches):
        total = np.zeros((len(names), FEATURES + 1), np.int64)
        for b in batches:
            for part in slices(b):
                of = np.array([names.index(x) for x in part.column("domain").to_pylist()], np.int64)
                doc, feature = _once(*_features(part)[:2])
                total += np.bincount(of[doc] * (FEATURES + 1) + feature, minlength=total.size).reshape(total.shape)
                total[:, FEATURES] += np.bincount(of, minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches):
        total = 0
        for b in batches:
            for blob in b.column("counts").to_pylist():
                total = total + np.frombuffer(blob, np.int64)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    # fixed-size sums: sixteen tasks, then one, add up what the scan's tasks send
    some = rows.mapInArrow(run, "counts binary").repartition(min(16, shuffle_parts(spark))).mapInArrow(add, "counts binary")
    got = some.repartition(1).mapInArrow(add, "counts binary").first()
    counts = np.frombuffer(got["counts"], np.int64) if got else np.zeros(len(names) * (FEATURES + 1), np.int64)
    counts = counts.reshape(len(names), FEATURES + 1)
    used = _telling(counts)
    where = np.nonzero(used)[0]

    def shown(batches):
        for b in batches:
            for part in slices(b):
                doc, feature, _ = _features(part)
                doc, feature = _once(doc[used[feature]], feature[used[feature]])
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                of = np.array([names.index(x) for x in part.column("domain").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.searchsorted(where, feature).astype(np.int32)))], names=["label", "at"])

    weight, base = np.zeros((len(names), len(where))), _prior(counts)
    if len(where) and (counts[:, -1] > 0).sum() > 1:
        # at most ``most`` rows: one small table for the iterations
        train = rows.mapInArrow(shown, "label double, at array<int>").repartition(min(8, shuffle_parts(spark))).checkpoint()
        vector = F.udf(lambda at: Vectors.sparse(len(where), at, [1.0] * len(at)), VectorUDT())
        model = LogisticRegression(family="multinomial", regParam=RIDGE, maxIter=ITERATIONS, standardization=False).fit(
            train.select("label", vector("at").alias("features")))
        some = model.coefficientMatrix.toArray()
        weight[:len(some)] = some
        base = np.full(len(names), -1e3)
        base[:len(some)] = np.maximum(model.interceptVector.toArray(), -1e3)
    at = np.full(FEATURES, -1, np.int32)
    at[where] = np.arange(len(where))
    return {"yes": weight, "base": base, "at": at}


def _prior(counts: np.ndarray) -> np.ndarray:
    docs = counts[:, -1].astype(float)
    return np.log((docs + SMOOTHING) / (docs.sum() + SMOOTHING * len(docs)))


def _telling(counts: np.ndarray) -> np.ndarray:
    """Which features are spread unevenly over the domains beyond chance; the rest are not learned from."""
    docs = counts[:, -1].astype(float)
    total, n = counts[:, :-1].sum(0), max(docs.sum(), 1.0)
    telling = np.zeros(FEATURES, bool)
    for seen, of in zip(counts[:, :-1], docs):
        variance = of * (1 - of / n) * (total / n) * (1 - total / n)
        telling |= (seen - of * total / n) ** 2 >= CHI2 * np.maximum(variance, 1e-9)
    return telling & (total >= MIN_DOCS)


def with_posteriors(docs: DataFrame, model: dict, text_col: str, keep: list) -> DataFrame:
    """The kept columns, ``__tokens`` (words) and ``__p`` (posterior per domain, in the order of DOMAINS)."""
    spark = ready(docs.sparkSession)
    bc = spark.sparkContext.broadcast(model)      # domains x FEATURES, whatever the corpus
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *keep)
    schema = rows.drop("__text").schema.add("__tokens", "long").add("__p", ArrayType(DoubleType()))

    def run(batches):
        m = bc.value
        k = len(m["base"])
        for b in batches:
            for part in slices(b):
                doc, feature, counts = _features(part)
                feature = m["at"][feature]
                doc, feature = _once(doc[feature >= 0], feature[feature >= 0])
                logp = np.stack([np.bincount(doc, m["yes"][d][feature], minlength=part.num_rows) for d in range(k)], 1) + m["base"]
                p = np.exp(logp - logp.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                ps = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts.astype(np.int64)), ps],
                                                 names=[*part.schema.names[1:], "__tokens", "__p"])

    return rows.mapInArrow(run, schema)


def _dot(p: Column, z) -> Column:
    return F.aggregate(F.zip_with(p, z, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def rate(p: Column, floor: Column, steps: list) -> Column:
    """The rate of a document after the steps: each moves it along its posteriors, then projects."""
    if not steps:
        return F.greatest(F.lit(1.0), floor)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in z]) for z in steps])
    return F.aggregate(history, F.lit(1.0), lambda w, z: F.greatest(floor, w - _dot(p, z)))


def fit_rates(table: DataFrame, targets: dict, keep: str | None = KEEP) -> tuple[list, dict]:
    """The steps of the projected gradient and what they reach.

    ``table`` holds ``__tokens`` and ``__p``.  The loss is the squared distance
    between expected and target totals; a step is the gradient scaled by the
    inverse second derivative over the documents that are off their bounds, halved
    while it does not lower the loss.
    """
    k = len(DOMAINS)
    floor = rate_floor(keep)

    def sums(steps: list, of) -> np.ndarray:
        rows = table.select("__p", F.col("__tokens").cast("double").alias("t"), rate(F.col("__p"), floor, steps).alias("w"), floor.alias("f"))
        return np.array([float(x or 0.0) for x in rows.agg(*of).first()])

    def totals(steps: list) -> np.ndarray:
        return sums(steps, [F.sum(F.col("t") * F.col("__p")[d] * F.col("w")) for d in range(k)])

    def curvature(steps: list, gap: np.ndarray) -> np.ndarray:
        """Second derivative over the documents that the gradient does not push against their bound."""
        free = F.when((F.col("w") > F.col("f")) | (_dot(F.col("__p"), F.array(*[F.lit(float(g)) for g in gap])) < 0), F.col("t")).otherwise(0.0)
        upper = sums(steps, [F.sum(free * F.col("__p")[a] * F.col("__p")[b]) for a in range(k) for b in range(a, k)])
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = upper
        return h + np.triu(h, 1).T

    steps: list = []
    total = totals(steps)
    want = np.array([targets[d] for d in DOMAINS]) * total     # the totals at rate 1 are what the corpus holds
    scale = max(float(total.sum()), 1.0)
    loss = float(((total - want) ** 2).sum())
    for _ in range(STEPS):
        if loss <= (TOLERANCE * scale) ** 2:
            break
        z = np.linalg.pinv(curvature(steps, total - want), rcond=1e-7) @ (total - want)
        for _ in range(HALVINGS):
            new_total = totals([*steps, z])
            new = float(((new_total - want) ** 2).sum())
            if new < loss:
                break
            z = z / 2
        else:
            break
        enough = loss - new <= 1e-3 * loss
        steps, total, loss = [*steps, z], new_total, new
        if enough:
            break
    return steps, {"target": dict(zip(DOMAINS, want.tolist())), "expected": dict(zip(DOMAINS, total.tolist())), "loss": loss, "steps": len(steps)}


def rate_floor(keep: str | None = KEEP) -> Column:
    if keep is None:
        return F.lit(0.0)
    at = list(DOMAINS).index(keep)
    return F.when(F.col("__p")[at] >= F.array_max("__p"), 1.0).otherwise(0.0)


def _copies(table: DataFrame, rate_: Column, seed: int, *key) -> DataFrame:
    """Adds the rate and the copies: the rate, rounded up with the probability of its fraction by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return table.withColumn("__rate", rate_).withColumn("__copies", F.floor(F.col("__rate") + u).cast("int"))


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict | None = None, keep: str | None = KEEP,
                   id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``__id, __hash`` (of the text), ``__tokens, __p, __rate, __copies`` per row of ``docs``, read once.

    A null or empty text has no tokens and the classifier's prior.  Without labels
    all domains are alike.  Documents whose likeliest domain is ``keep`` have a rate
    of 1 at least, so mixing thins out and repeats but never loses such a document.
    """
    rows, _, steps = _fitted(docs, labels, targets, keep, id_col, text_col)
    return _copies(rows, rate(F.col("__p"), rate_floor(keep), steps), seed, "__id", "__hash")


def _fitted(docs, labels, targets, keep, id_col, text_col):
    model = fit_classifier(docs, labels, id_col, text_col)
    text = F.col(text_col)
    small = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__t"))
    rows = with_posteriors(small, model, "__t", ["__id", "__hash"]).checkpoint()
    return rows, model, fit_rates(rows, targets or TARGETS, keep)[0]


def mix(docs: DataFrame, labels: DataFrame, targets: dict | None = None, keep: str | None = KEEP, id_col: str = "doc_id",
        text_col: str = "text", seed: int = 17) -> DataFrame:
    """``docs`` with ``__tokens``, ``__p``, ``__rate`` and ``__copies``, as ``document_rates``
    has them.  Nothing is dropped here; ``repeated`` carries the copies out."""
    _, model, steps = _fitted(docs, labels, targets, keep, id_col, text_col)
    docs, new = plain_names(docs)
    text = new[text_col]
    # the posteriors are predicted again, which is cheaper than to shuffle the texts to them
    table = with_posteriors(docs, model, text, docs.columns)
    out = _copies(table, rate(F.col("__p"), rate_floor(keep), steps), seed, new[id_col], F.xxhash64(text))
    return own_names(out, new, *ADDED)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, with the columns that the documents had."""
    rows, new = plain_names(mixed)
    copies = F.explode(F.sequence(F.lit(1), F.col(new["__copies"])))
    out = rows.filter(F.col(new["__copies"]) > 0).withColumn("__copy", copies)
    return own_names(out, {name: c for name, c in new.items() if name not in ADDED})
