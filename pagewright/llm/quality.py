"""Compression classifier: how much better a dictionary of good text compresses a document than one of bad text.

Two zstandard dictionaries are trained, one on documents labelled good and one on documents labelled bad.
The evidence for a text is the difference of its two compressed sizes over its length. Logistic
regression on other labelled rows turns it into a probability, given the size without a dictionary (which
tells text that repeats itself) and the length (which tells how much a difference means).

Labels are learned only from rows whose crc32 of the doc id, as text, leaves no 1 modulo 3: remainder 0
gives the dictionaries, remainder 2 the calibration. Both read bounded samples drawn by a hash of the
row: ``DICTIONARY_DOCUMENTS`` of each label, of at most ``DICTIONARY_CHARS`` characters each, and
``CALIBRATION_DOCUMENTS`` rows. Every document is scored, whole.

Null and empty texts score the share of good rows in the calibration sample. Null ids count as not
held out. Labels other than 0 and 1 are not used. Without labelled rows of both kinds every score is that
share, or one half without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import add_columns, byte_texts
from pagewright.llm.sampling import drawn
from pagewright.session import cut_lineage

DICTIONARY_DOCUMENTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 1500, 10_000, 110 * 1024
CALIBRATION_DOCUMENTS = 4000
LEVEL = 3
#: Bytes of one training sample; zstandard wants many small ones.
SAMPLE_BYTES = 2000


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class QualityModel:
    """Two dictionaries and the weights of the calibration."""

    good: bytes = b""
    bad: bytes = b""
    mean: list[float] = field(default_factory=lambda: [0.0] * 3)
    scale: list[float] = field(default_factory=lambda: [1.0] * 3)
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    prior: float = 0.5

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Rows of (size difference, size without dictionary, length term); empty texts give NaN."""
        press = [_press(self.good), _press(self.bad), _press(b"")]
        out = np.full((len(texts), 3), np.nan)
        for row, text in enumerate(texts):
            if text:
                good, bad, plain = (len(p.compress(text)) for p in press)
                n = len(text)
                out[row] = (bad - good) / n, plain / n, n**-0.5
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.mean) / self.scale
        logit = np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)
        return np.where(np.isnan(logit), self.prior, 1 / (1 + np.exp(-logit)))


def _press(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False)


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[i : i + SAMPLE_BYTES] for t in texts for i in range(0, len(t), SAMPLE_BYTES)]
    size = sum(map(len, samples))
    if len(samples) < 16 or size < 20 * 1024:  # too little to train on: the text itself serves
        return b"\n".join(samples)[:DICTIONARY_BYTES]
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 4), samples, level=LEVEL).as_bytes()


def train(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on bounded samples of the labelled rows of folds 0 and 2."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"), fold_of(F.col("doc_id")).alias("_fold"))
    known = known.where(F.col("_label").isin(0, 1) & F.col("_fold").isin(0, 2))
    sizes = {(r._fold, r._label): r["count"] for r in known.groupBy("_fold", "_label").count().collect()}

    def some(n: int, fold: int, *kinds: int) -> DataFrame:
        rows = known.where((F.col("_fold") == fold) & F.col("_label").isin(*kinds))
        return drawn(rows, n, "quality", of=sum(sizes.get((fold, k), 0) for k in kinds))

    kept = some(DICTIONARY_DOCUMENTS, 0, 1).union(some(DICTIONARY_DOCUMENTS, 0, 0)).union(some(CALIBRATION_DOCUMENTS, 2, 0, 1))
    # Bounded by the three sample sizes, so small enough to broadcast.
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where("length(_text) > 0")
    sample = cut_lineage(texts.join(F.broadcast(kept), "_id").select("_id", "_label", "_fold", "_text"))
    rows = sample.where(f"_fold = 0 AND length(_text) <= {DICTIONARY_CHARS}").orderBy("_id", "_text").collect()
    by_label = [[r._text.encode() for r in rows if r._label == k][:DICTIONARY_DOCUMENTS] for k in (0, 1)]
    model = QualityModel(good=_dictionary(by_label[1]), bad=_dictionary(by_label[0]))

    def measure(batches):
        for b in batches:
            found = model.evidence(byte_texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, found.T), b.column(1).cast(pa.int64())], ["a", "b", "c", "y"])

    measured = (
        sample.where("_fold = 2").select("_text", F.col("_label").cast("long")).mapInArrow(measure, "a double, b double, c double, y long").collect()
    )
    found = np.array(sorted(tuple(r) for r in measured)).reshape(-1, 4)
    x, y = found[:, :3], found[:, 3]
    if len(y):
        model.prior = float(y.mean())
    if by_label[0] and by_label[1] and 0 < model.prior < 1:
        model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
        model.weights = _logistic((x - model.mean) / model.scale, y)
    else:
        model.weights = [float(np.log((model.prior + 1e-9) / (1 - model.prior + 1e-9))), 0.0, 0.0, 0.0]
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _scored(documents: DataFrame, model: QualityModel) -> DataFrame:
    def score(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(model.score(model.evidence(texts)))]

    return add_columns(documents, "text", "score double", score)


def score_documents(documents: DataFrame, model: QualityModel) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): held_out, score and predicted (1 from a half on)."""
    return _scored(documents.select("doc_id", "text"), model).select(
        F.col("_0").alias("doc_id"),
        F.coalesce(fold_of(F.col("_0")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that score a half or more, all columns as they were."""
    scored = _scored(documents, model)
    return scored.where("score >= 0.5").drop("score").toDF(*documents.columns)
