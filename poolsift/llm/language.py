"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary naive-Bayes classifier
over hashed letter n-grams separates the languages whose bit is 1 from the
others.  A text gets one margin per bit; the language whose codeword has the
smallest weighted loss against the margins is predicted.  All training rows are
counted, in one pass whose result has a fixed size per language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, shuffle_parts, slices

FEATURES = 1 << 13
EXHAUSTIVE = 7        # up to so many languages every distinct split of them is a bit
SHARPNESS = 60.0      # turns mean margins per n-gram into probabilities
AMBIGUOUS = 0.75      # scores below are flagged
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def _points(text: str) -> np.ndarray:
    """Lower-case code points, everything but letters as 0."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(p), bool)
    low = p < 0x10000
    letter[low] = _letters()[p[low]]
    for c in np.unique(p[~low]):
        letter[p == c] = chr(int(c)).isalpha()
    return np.where(letter, p, 0).astype(np.uint32)


def count_ngrams(text: str | None) -> np.ndarray | None:
    """Counts of hashed one- to three-letter n-grams of a whole text; None if it has no letter."""
    p = _points(text) if text else np.empty(0, np.uint32)
    mid = np.nonzero(p)[0]
    if not len(mid):
        return None
    q = np.concatenate([np.zeros(1, np.uint32), p, np.zeros(1, np.uint32)])
    a, b, c = q[mid], q[mid + 1], q[mid + 2]
    k = np.uint32
    one = b * k(2654435761)
    two = (a * k(2246822519) + b) * k(3266489917) + k(1)
    three = ((a * k(668265263) + b) * k(374761393) + c) * k(2654435761) + k(2)
    shift = k(32 - (FEATURES.bit_length() - 1))
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=FEATURES)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n languages, bits) of 0/1: every split of the languages into two sides if they are few,
    else random splits, of which the set with the largest smallest distance is taken."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        masks = np.arange(1, 1 << (n - 1))
        return ((masks[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    rng = np.random.default_rng(seed)
    bits, best, best_d = 12 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(50):
        m = (rng.random((n, bits)) < 0.5).astype(np.int8)
        m = m[:, (m.sum(0) > 0) & (m.sum(0) < n)]
        s = 2 * m.astype(np.int32) - 1
        d = ((m.shape[1] - s @ s.T) // 2 + np.eye(n, dtype=np.int32) * bits).min()
        if d > best_d:
            best, best_d = m, d
    return best


def _summed(blobs: DataFrame, parts: int, *by: str) -> DataFrame:
    """Adds up count vectors per language, one language's running sum in memory for each seen."""
    def run(batches):
        total: dict = {}
        for b in batches:
            for lang, blob in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist()):
                v = np.frombuffer(blob, np.int64)
                total[lang] = total[lang] + v if lang in total else v
        yield _rows(total)

    return blobs.repartition(parts, *by).mapInArrow(run, "lang string, salt int, counts binary")


def _rows(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([0] * len(total), pa.int32()),
         pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["lang", "salt", "counts"])


def train(rows: DataFrame, text_col: str, lang_col: str) -> dict:
    """The model of all rows with a language: a dictionary of small arrays.

    Rows with a null language, or without a letter, teach nothing; no rows give a model without languages.
    """
    spark = ready(rows.sparkSession)
    sel = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"),
                                                          F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        from pyspark import TaskContext

        total: dict = {}
        for b in batches:
            for part in slices(b):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("__text").to_pylist()):
                    v = count_ngrams(text)
                    if v is not None:
                        if lang in total:
                            total[lang] += v
                        else:
                            total[lang] = v
        out = _rows(total)
        yield out.set_column(1, "salt", pa.array([TaskContext.get().partitionId() % 64] * len(total), pa.int32()))

    blobs = sel.mapInArrow(run, "lang string, salt int, counts binary")
    once = _summed(blobs, shuffle_parts(spark), "lang", "salt")
    found = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in _summed(once, shuffle_parts(spark), "lang").collect()}
    return fit(found)


def fit(counts: dict) -> dict:
    langs = sorted(counts)
    code = codewords(len(langs))
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * FEATURES) for x in langs]).reshape(len(langs), FEATURES)
    odds = np.zeros((FEATURES, code.shape[1]))
    for b in range(code.shape[1]):
        # languages count alike on either side, however many rows each has
        odds[:, b] = np.log(p[code[:, b] == 1].mean(0)) - np.log(p[code[:, b] == 0].mean(0))
    sign = 2.0 * code - 1
    # how far a text of the language is expected to fall on the right side of each bit
    weight = np.maximum(sign * (p @ odds), 1e-6)
    weight /= np.maximum(weight.sum(1, keepdims=True), 1e-12)
    return {"langs": langs, "sign": sign, "odds": odds, "weight": weight}


def decode(model: dict, counts: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and whether the second-best codeword is close."""
    if not model["langs"]:
        return UNKNOWN, 0.0, True
    if len(model["langs"]) == 1:
        return model["langs"][0], 1.0, False
    margin = SHARPNESS * (counts @ model["odds"]) / counts.sum()
    loss = (model["weight"] * np.logaddexp(0.0, -model["sign"] * margin)).sum(1)
    like = np.exp(loss.min() - loss)
    best = int(np.argmin(loss))
    score = float(like[best] / like.sum())
    return model["langs"][best], score, score < AMBIGUOUS


def predict(docs: DataFrame, model: dict, keep: list, text_col: str = "text") -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text, or one without a letter, gets ``und`` with score 0, flagged.
    The model (languages x bits x features, no row counts) is broadcast.
    """
    spark = ready(docs.sparkSession)
    bc = spark.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *keep)
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        m = bc.value
        for b in batches:
            for part in slices(b):
                out = [(UNKNOWN, 0.0, True) if (v := count_ngrams(t)) is None else decode(m, v)
                       for t in part.column("__text").to_pylist()]
                cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols],
                                                 names=[*part.schema.names[1:], "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text is divisible by five; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row:
    ``doc_id, held_out, lang_pred, score, ambiguous``."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    named = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("__t"))
    return predict(named, model, ["doc_id", "held_out"], "__t")
