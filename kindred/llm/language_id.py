"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by gradient descent in numpy.

A text is the mean of the embeddings of all its words' character n-grams. The softmax is calibrated by a temperature on rows
the training did not see, and rejects texts whose calibrated score is below a fixed low quantile of the scores of those rows.
"""

import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
ROWS_PER_LANGUAGE = 1500
SLICES = 16
# With fewer labelled rows every row calibrates, scored by a model that did not see it; else every tenth does.
CROSS_FIT_BELOW, FOLDS = 1000, 5
# Of texts in a known language about this share is rejected, however many rows calibrate.
REJECTED_SHARE = 0.01
EPOCHS = 12
BATCH = 64
SMOOTHING = 0.02
UNKNOWN = "und"
PRIME, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and is it part of a word (a letter or a mark)."""
    points = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in points), bool, len(points))
    return letter, letter | np.fromiter((unicodedata.category(c)[0] == "M" for c in points), bool, len(points))


def subwords(text: str) -> np.ndarray:
    """Buckets of the character n-grams of all words, each word between two marks; none for a text without a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, word = _classes()
    if not letter[points].any():
        return np.zeros(0, np.int64)
    inside = word[points]
    points = np.where(inside, points, np.uint32(1))
    # Of neighbouring marks one is enough.
    keep = inside | np.concatenate([[True], inside[:-1]])
    points, inside = points[keep], inside[keep]
    out = []
    hashed, good = points * SPREAD, inside
    for n in GRAMS:
        if n > 1:
            hashed = hashed[:-1] * PRIME + points[n - 1 :] * SPREAD
            # A mark may only be the first or the last sign; a longer gram must not run over it.
            good = (inside[:-1] | inside[1:]) if n == 2 else good[:-1] & inside[n - 2 : len(points) - 1]
        out.append((hashed[good] * SPREAD) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated score."""
        grams = subwords(text) if text and self.languages else ()
        if not len(grams):
            return UNKNOWN, 0.0
        z = np.bincount(grams, minlength=BUCKETS) @ self.logits / len(grams) + self.bias
        p = softmax(z[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """lang and bucket counts of at most so many rows of each language, those with the smallest hash of their doc_id.

    Ranked in two steps, by language and hash slice and then by language: the first step needs few rows of a slice, so Spark
    prunes it on the map side (spark.sql.optimizer.windowGroupLimitThreshold), and no task gathers a whole language. A slice
    keeps twice its even share and 50 more, which no hash of that many different ids exceeds.
    """
    from pyspark.sql import Window

    labelled = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sliced = labelled.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("_slice"))
    first = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    few = sliced.withColumn("_first", first).where(F.col("_first") <= min(rows_per_language, 2 * -(-rows_per_language // SLICES) + 50))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = few.select("doc_id", "lang", rank.alias("_rank")).where(F.col("_rank") <= rows_per_language)
    rows = labelled.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    # An id may have come with many rows.
    again = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.xxhash64("text")))
    rows = rows.withColumn("_rank", again).where(F.col("_rank") <= rows_per_language).select("lang", "doc_id", "text")

    def count(batches):
        for batch in batches:
            out = {"lang": [], "key": [], "buckets": [], "counts": []}
            for lang, id_, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grams = subwords(text)
                if len(grams):
                    buckets, counts = np.unique(grams, return_counts=True)
                    out["lang"].append(lang)
                    out["key"].append(str(id_))
                    out["buckets"].append(buckets.astype(np.int16).tobytes())
                    out["counts"].append(counts.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "key": pa.array(out["key"], pa.string()),
                                              "buckets": pa.array(out["buckets"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return rows.mapInArrow(count, "lang string, key string, buckets binary, counts binary")


def _dense(rows: list) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, row in enumerate(rows):
        counts = np.frombuffer(row.counts, np.float32)
        x[k, np.frombuffer(row.buckets, np.int16)] = counts / counts.sum()
    return x


def _train(rows: list, languages: list[str], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits and bias."""
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    target = np.array([languages.index(r.lang) for r in rows], np.int64)
    balance = len(rows) / (len(languages) * np.bincount(target, minlength=len(languages)).clip(1))
    seen_e, seen_w = np.full(BUCKETS, 1e-12, np.float32), np.full_like(weight, 1e-12)
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            pick = order[a : a + BATCH]
            x = _dense([rows[k] for k in pick])
            hidden = x @ embed
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(pick)), target[pick]] -= 1
            error *= (balance[target[pick]] / len(pick))[:, None]
            # Steps are scaled by the squared gradients seen so far: rare buckets and frequent ones learn alike.
            step_w, step_e = hidden.T @ error, x.T @ (error @ weight.T)
            seen_w += step_w**2
            seen_e += (step_e**2).mean(1)
            weight -= rate * step_w / np.sqrt(seen_w)
            bias -= 0.1 * rate * error.sum(0)
            embed -= rate * step_e / np.sqrt(seen_e)[:, None]
    return embed.astype(float) @ weight.astype(float), bias.astype(float)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """Trains on the given rows (doc_id, text, lang), at most `rows_per_language` of each language.

    Every tenth row calibrates and trains nothing. Below CROSS_FIT_BELOW rows all of them train the model, and each calibrates
    by the score of another one that was trained without its fold. The threshold is the REJECTED_SHARE quantile of the
    calibrated scores of rightly predicted calibration rows. Without labelled rows the model knows no language and answers
    `und` always.
    """
    rows = sorted(sample(docs, rows_per_language).collect(), key=lambda r: (zlib.crc32(r.key.encode()), r.key, r.lang))
    languages = sorted({r.lang for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)

    def scores(held, logits, bias):
        return np.concatenate([_dense(held[a : a + 256]) @ logits for a in range(0, len(held), 256)]) + bias

    if len(rows) >= CROSS_FIT_BELOW:
        held = rows[::10]
        logits, bias = _train([r for k, r in enumerate(rows) if k % 10], languages, epochs)
        z = scores(held, logits, bias)
    else:
        logits, bias = _train(rows, languages, epochs)
        folds = [rows[k::FOLDS] for k in range(min(FOLDS, len(rows)))]
        held = [r for fold in folds for r in fold]
        z = np.concatenate([scores(fold, *_train([r for other in folds if other is not fold for r in other], languages, epochs)) for fold in folds])
    truth = np.array([languages.index(r.lang) for r in held])
    temperatures = np.geomspace(0.05, 50, 80)
    # Smoothed targets: rows that are all right would else ask for endless confidence.
    goal = np.eye(len(languages))[truth] * (1 - SMOOTHING) + SMOOTHING / len(languages)
    losses = [-(goal * np.log(softmax(z / t) + 1e-12)).sum(1).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == truth]
    threshold = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return Model(languages, logits, bias, temperature, threshold)


def held_out(doc_id) -> "F.Column":
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row, from the whole text alone.

    A text that is null or has no letter is `und` with score 0 and rejected.
    """

    def judge(batches):
        for batch in batches:
            out = [model.score(text) for text in batch.column(1).to_pylist()]
            lang, value = [o[0] for o in out], [o[1] for o in out]
            rejected = [o[0] == UNKNOWN or o[1] < model.threshold for o in out]
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def _learnt(docs: DataFrame, rows_per_language: int) -> Model:
    return fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), rows_per_language)


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row; learns from the rows that are not held out.

    A null doc_id is not held out, repeated rows are judged alike, an empty table stays empty. Without labelled rows every
    language is `und`. Of other columns only lang is read, and only to learn.
    """
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return predict(docs, _learnt(docs, rows_per_language)).select("doc_id", held, "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows whose language the model accepts, with all their own columns."""
    model = _learnt(docs, rows_per_language)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            judged = (model.score(text) for text in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and value >= model.threshold for lang, value in judged], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
