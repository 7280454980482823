"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good, a bounded sample of them; the unlabelled web text is every other document that
may be learned from. The share of good text among the unlabelled (the class prior) is estimated by the best-bin method:
the smallest ratio, over score thresholds, of the unlabelled share above a threshold to the positive share above it. Training
minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The unlabelled documents are dealt
by hash into blocks of a fixed size; each block and the positives train a model on the features' common scale, and the
blocks' models are averaged by their sizes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm._base import importable, release, summed, text_of, written

#: Trusted positives at most, taken by a hash of the id, and unlabelled documents of a block.
POSITIVES = 6_000
BLOCK = 12_000
#: Score from which a text counts as good.
THRESHOLD = 0.3
#: ASCII characters with a class of their own, besides letters, digits and blanks.
MARKS = ".,!?#%*$&|-_/:;<>=()[]{}\"'@+~^\\`"
CLASSES = 8 + len(MARKS)
#: Besides byte classes: lengths, repetition, upper case.
SUMMARY = 9
FEATURES = CLASSES * CLASSES + CLASSES + SUMMARY


def _byte_classes() -> np.ndarray:
    """0: control characters, 1: lower case, 2: upper case, 3: digits, 4: blanks, 5: line ends, 6: lead bytes, 7: trail bytes, then marks."""
    c = np.zeros(256, dtype=np.int64)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 1, 2, 3
    c[[9, 32]], c[[10, 13]], c[192:], c[128:192] = 4, 5, 6, 7
    for k, m in enumerate(MARKS):
        c[ord(m)] = 8 + k
    return c


BYTE_CLASS = _byte_classes()


def features(body: bytes) -> np.ndarray:
    """Of the whole text: square roots of the shares of byte-class pairs and byte classes, lengths and repetition."""
    out = np.zeros(FEATURES, dtype=np.float32)
    data = np.frombuffer(body, dtype=np.uint8)
    if not len(data):
        return out
    pairs, single = np.zeros(CLASSES * CLASSES), np.zeros(CLASSES)
    for at in range(0, len(data), 1 << 20):  # bounded memory for very long texts
        c = BYTE_CLASS[data[at : at + (1 << 20) + 1]]
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        single += np.bincount(c[: 1 << 20], minlength=CLASSES)
    words, lines = body.split(), body.split(b"\n")
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1.0, pairs.sum()))
    out[CLASSES * CLASSES : -SUMMARY] = np.sqrt(single / single.sum())
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:]))
    top = max(Counter(words).values(), default=0)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    out[-SUMMARY:] = (
        np.log1p(len(data)) / 10, np.log1p(len(words)) / 10, len(set(words)) / n, len(set(lines)) / len(lines), len(data) / n / 20,
        again / n, np.sqrt(again / n), top / n, upper / n,
    )
    return out


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores that neither side was trained on: the lower end of its confidence band.

    Too high a prior stops training before the bad texts are told apart (the clamp at zero sets in early); too low a one only
    lowers the scores of good texts a little.
    """
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip((u[best] - slack / 2) / p[best], 0.05, 0.95))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = standardise(np.array(x), self.mean, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pack(x: np.ndarray) -> bytes:
    """The features that aren't zero: places (16 bits), then values (32 bits)."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpack(rows: list[bytes], seen: np.ndarray | None = None) -> np.ndarray:
    """The rows as a matrix, of the features `seen` alone if given (sorted; no row has others)."""
    out = np.zeros((len(rows), FEATURES if seen is None else len(seen)), dtype=np.float32)
    place = np.arange(FEATURES) if seen is None else np.searchsorted(seen, np.arange(FEATURES))
    for x, row in zip(out, rows, strict=True):
        n = len(row) // 6
        x[place[np.frombuffer(row, "<u2", n)]] = np.frombuffer(row, "<f4", n, 2 * n)
    return out


def places(rows: list[bytes]) -> np.ndarray:
    """The features that any of the rows has: most pairs of byte classes never occur."""
    found = np.zeros(FEATURES, dtype=bool)
    for row in rows:
        found[np.frombuffer(row, "<u2", len(row) // 6)] = True
    return np.flatnonzero(found)


def standardise(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """In place."""
    x -= mean
    x /= scale
    return np.clip(x, -8, 8, out=x)


def train(positive: list[bytes], unlabelled: list[bytes], mean: np.ndarray, scale: np.ndarray, prior: float | None = None, steps: int = 1200, seed: int = 7) -> Model:
    """Minimises the non-negative risk with the logistic loss; the prior is estimated on a third left out first. Rows as pack() makes them."""
    rng = np.random.default_rng(seed)
    seen = np.union1d(places(positive), places(unlabelled))
    p, u = (standardise(unpack(x, seen), mean[seen], scale[seen]) for x in (positive, unlabelled))
    if prior is None:
        cut_p, cut_u = np.arange(len(p)) % 3 == 0, np.arange(len(u)) % 3 == 0
        w, b = _descend(p[~cut_p], u[~cut_u], 0.5, steps // 2, rng)
        prior = best_bin_prior(p[cut_p] @ w + b, u[cut_u] @ w + b)
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[seen], b = _descend(p, u, prior, steps, rng)
    return Model(mean, scale, weights, b, prior)


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    w, b = np.zeros(p.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        x, y = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
        sp, su = 1 / (1 + np.exp(-(x @ w + b))), 1 / (1 + np.exp(-(y @ w + b)))
        plus = (prior * (sp - 1) / len(x), x)  # gradient of prior * R+(P): loss -log s
        minus_u, minus_p = (su / len(y), y), (-prior * sp / len(x), x)  # of R-(U) - prior * R-(P): loss -log(1 - s)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean()
        parts = [plus, minus_u, minus_p] if negative >= 0 else [(-minus_u[0], y), (-minus_p[0], x)]  # below zero: step back
        g = np.r_[sum(c @ a for c, a in parts) + 2e-4 * w, sum(c.sum() for c, _ in parts)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), float(b - move[-1])
    return w, b


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo the folds; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _share(n: int, bound: int, id_col: str, salt: int) -> Column:
    """True for about `bound` of n ids, by their hashes."""
    if n <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 30)) < int((1 << 30) * bound / n)


def described(docs: DataFrame) -> DataFrame:
    """docs (with a string `text`) with `x`, the features of the whole text, in its place; null counts as empty."""
    importable(docs.sparkSession)

    @F.pandas_udf("binary")
    def pack_all(bodies):
        import pandas as pd

        found = pd.Series([pack(features(b)) for b in bodies], dtype=object)
        release()
        return found

    return docs.withColumn("x", pack_all(F.encode(text_of("text"), "UTF-8"))).drop("text")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((2, FEATURES)), 0
    for batch in batches:
        x = unpack(batch.column(0).to_pylist()).astype(np.float64)
        total += [x.sum(0), (x * x).sum(0)]
        n += len(x)
    release()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "numbers"])


def _block_model(shared):
    def run(pdf):
        import pandas as pd

        positive, mean, scale = shared.value
        pdf = pdf.sort_values("x")  # the order of tasks must not matter
        model = train(positive, pdf["x"].tolist(), mean, scale)
        release()
        n = len(pdf)
        return pd.DataFrame({"n": [n], "numbers": [(n * np.r_[model.weights, model.bias, model.prior]).astype(np.float64).tobytes()]})

    return run


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, block: int = BLOCK) -> Model:
    """Learns from rows (doc_id, x; written) and labels (doc_id, quality) of documents that are not held out.

    Trusted positives: a bounded hash sample of documents that a label calls good and none calls bad. Unlabelled: all
    documents, whether they have a label or not. Without either, the model scores everything 1.
    """
    spark = rows.sparkSession
    free = rows.where(F.col("doc_id").isNotNull() & ~held_out())
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("worst")).where("worst = 1").select("doc_id")
    good = good.where(~held_out())
    wanted = good.where(_share(good.count(), positives, "doc_id", 5))
    p = sorted(bytes(r["x"]) for r in free.join(F.broadcast(wanted), "doc_id", "left_semi").select("x").collect())  # broadcast: about `positives` ids
    count = free.count()
    if not p or not count:
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 30.0, 1.0)
    n, total = summed(free.select("x").mapInArrow(_moments, "n long, numbers binary"))
    mean, square = total.reshape(2, FEATURES) / n
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 0.02
    shared = spark.sparkContext.broadcast((p, mean.astype(np.float32), scale.astype(np.float32)))
    dealt = free.select("x", F.pmod(F.xxhash64(F.lit(3), "doc_id", "x"), F.lit(-(-count // block))).alias("block"))
    n, total = summed(dealt.groupBy("block").applyInPandas(_block_model(shared), "n long, numbers binary"))
    total /= n
    return Model(shared.value[1], shared.value[2], total[:FEATURES].astype(np.float32), float(total[-2]), float(total[-1]))


def fit_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """fit() on documents as they are; ids of labels are compared with ids of docs."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fit(written(described(slim), "features"), labels.select(F.col(id_col).alias("doc_id"), "quality"))


def scorer(model: Model):
    """A UDF from features to scores."""

    @F.pandas_udf("double")
    def scores(rows):
        import pandas as pd

        return pd.Series([float(x) for k in range(0, len(rows), 256) for x in model.score(unpack(rows.iloc[k : k + 256].tolist()))], dtype=float)

    return scores


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores (double, 0 to 1) of the whole texts; null counts as empty. docs must not have a column of that name."""
    importable(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(bodies):
        import pandas as pd

        found = pd.Series([float(x) for k in range(0, len(bodies), 256) for x in model.score(np.stack([features(b) for b in bodies.iloc[k : k + 256]]))], dtype=float)
        release()
        return found

    return docs.withColumn(into, scores(F.encode(text_of(text_col), "UTF-8")))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; see fit(). Features of a text are made once and written.

    Empty and null texts are scored like others, very long ones by their whole length; repeated rows get equal scores; a null
    id is scored but not learned from; other columns are left out, whatever their names. An empty table gives an empty
    result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(described(slim), "features")
    model = fit(rows, labels.select(F.col(id_col).alias("doc_id"), "quality"))
    return rows.withColumn("score", scorer(model)("x")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
