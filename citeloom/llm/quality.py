"""Quality classifier: compressed sizes under two zstandard dictionaries, one built from good and one from bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize

CHUNK = 512
LEVEL = 1


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of doc_id as text is divisible by folds. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration of their features; small enough to send with each task."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ np.array(self.weights), -30, 30)))


def _features(text: str | None, compressors) -> tuple[float, float]:
    """The normalised difference of the compressed sizes (bad less good), and the log of compressed over plain size.

    Every chunk of the whole text is compressed by itself, so that the dictionaries and not the text's own past explain it.
    The first value is the classifier's signal; the second, for junk that neither dictionary explains, only corrects it.
    """
    good, bad = compressors
    plain = small = large = 0
    for chunk in _chunks(text):
        plain += len(chunk)
        small += len(good.compress(chunk))
        large += len(bad.compress(chunk))
    return ((large - small) / (large + small), float(np.log((large + small) / (2 * plain)))) if plain else (0.0, 0.0)


def _design(features: np.ndarray) -> np.ndarray:
    f = np.asarray(features, float).reshape(-1, 2)
    d, r = np.clip(f[:, 0] * 20, -4, 4), np.clip(f[:, 1], -4, 1)
    return np.column_stack([np.ones(len(f)), d, r, np.minimum(r + 1.5, 0)])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge that keeps separable samples finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1200, max_chars: int = 20_000, dictionary_bytes: int = 112_640, exclude: Column | None = None) -> Model:
    """Fit on at most per_class labelled texts of at most max_chars characters for each quality (the documented bound).

    labels: doc_id, quality (0 or 1); exclude: a condition on doc_id of rows never to learn from. Rows of contradicting,
    null or other labels teach nothing. The sample is the smallest xxhash64(doc_id), so reruns agree. Two thirds build the
    dictionaries, one third calibrates; the intercept is then moved to the classes' shares among all usable labels. A
    class without examples gives a model that scores every text with the share of the other (0.5 without labels).
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)")
    usable = usable.where(~exclude) if exclude is not None else usable
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    usable = materialize(usable, "labels")
    total = {int(r["quality"]): r["count"] for r in usable.groupBy("quality").count().collect()}
    one = F.xxhash64(F.lit("sample"), "doc_id")
    ids = [usable.where(F.col("quality") == q).orderBy(one, "doc_id").limit(2 * per_class) for q in (0, 1)]
    sample = materialize(ids[0].unionByName(ids[1]), "label-sample")
    texts = documents.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(F.broadcast(sample), "doc_id")
    texts = materialize(texts.select("doc_id", "text", "quality", one.alias("h")), "labelled")
    rows = {q: [r["text"] for r in texts.where(F.col("quality") == q).orderBy("h", "text").limit(per_class).collect()] for q in (0, 1)}
    share = total.get(1, 0) / max(1, sum(total.values()))
    if min(map(len, rows.values())) < 9:
        return Model(b"", b"", (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0, 0.0))
    built = {}
    for q, texts_q in rows.items():
        parts = [c for i, t in enumerate(texts_q) if i % 3 for c in _chunks(t)]
        try:
            built[q] = zstandard.train_dictionary(dictionary_bytes, parts).as_bytes()
        except zstandard.ZstdError:  # too little text for statistics: the text itself is the dictionary
            built[q] = b"".join(parts)[-dictionary_bytes:]
    compressors = Model(built[1], built[0], ()).compressors()
    held = [(q, t) for q in (0, 1) for i, t in enumerate(rows[q]) if not i % 3]
    y = np.array([q for q, _ in held], float)
    w = _fit(_design(np.array([_features(t, compressors) for _, t in held])), y)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(built[1], built[0], tuple(map(float, w)))


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """documents' doc_id and text, with a quality score between 0 and 1 from the whole text alone.

    Null and empty texts count as neutral features. Repeated rows score alike; other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        compressors = model.compressors() if model.good else None
        for batch in batches:
            f = np.array([_features(t.as_py(), compressors) if compressors else (0.0, 0.0) for t in batch.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f))], ["doc_id", column])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, `{column}` double")


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of documents that score at least threshold; all columns are kept as they are.

    Null and empty texts have neutral features, and stay or go by the model's intercept. Repeated rows score alike; an
    empty table gives no rows.
    """
    names = documents.columns

    def run(batches):
        compressors = model.compressors() if model.good else None
        for batch in batches:
            texts = batch.column(names.index("text"))
            f = np.array([_features(t.as_py(), compressors) if compressors else (0.0, 0.0) for t in texts]).reshape(-1, 2)
            yield batch.filter(pa.array(model.score(f) >= threshold))

    return documents.mapInArrow(run, documents.schema)
