"""Quality classifier: neighbours in a latent semantic space vote.

A text's terms are hashed byte trigrams and the steps of a few shares of its
form (length, distinct trigrams, capitals, signs, digits, repeated lines),
weighted by inverse document frequency over all documents. The latent space
is the leading singular vectors of a bounded sample of labelled texts. Every
document's vector is multiplied with those of all labelled texts of the
sample, block by block; the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Texts, cuts, map_texts, texts_of

# Labelled rows that are learnt from (the rows with the least hash of doc_id),
# dimensions of the space, neighbours that vote, and the power of the
# similarity in a vote.
SAMPLE, LATENT, NEIGHBOURS, POWER = 4096, 64, 15, 8

TRIGRAMS = 4096
STEPS = 24
FORMS = 8
TERMS = TRIGRAMS + FORMS * STEPS
FORM_WEIGHT = 3.0

# Texts handled at a time (one dense row of terms each).
ROWS = 512


def _steps(share: np.ndarray) -> np.ndarray:
    return np.clip((share * STEPS).astype(np.int64), 0, STEPS - 1)


def terms(texts: Texts) -> np.ndarray:
    """A row of term weights for each text, before document frequencies: damped trigram counts, and smoothed form steps."""
    n = len(texts)
    data = texts.data.astype(np.int64)
    size = np.diff(texts.off)
    row = np.arange(n).repeat(size)
    out = np.zeros((n, TERMS), np.float32)
    distinct = np.zeros(n)
    if len(data) > 2:
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        whole = row[:-2] == row[2:]
        code, of = code[whole], row[:-2][whole]
        kind = (code * 0x9E3779B1 >> 12) % TRIGRAMS
        tf = np.bincount(of * TRIGRAMS + kind, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.log1p(tf)
        distinct = np.bincount(np.unique(of << 24 | code) >> 24, minlength=n)[:n]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.maximum(norm, 1e-9)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row, flags, n)[:n] / np.maximum(size, 1)

    d = texts.data
    lines, repeats = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts.each()):
        parts = [p for p in t.split(b"\n") if p.strip()]
        lines[i], repeats[i] = len(parts), len(parts) - len(set(parts))
    words = np.bincount(row[1:], ((d[1:] > 32) & (d[:-1] <= 32)).astype(float), n)[:n] + 1 if len(d) else np.ones(n)
    forms = [
        np.log2(size + 1) / 20,
        distinct / np.maximum(np.minimum(size, 50 * np.sqrt(size + 1.0)), 1),
        3 * share((d >= 65) & (d < 91)),
        4 * share(((d >= 33) & (d < 48)) | ((d >= 58) & (d < 65)) | ((d >= 91) & (d < 97)) | ((d >= 123) & (d < 127))),
        4 * share((d >= 48) & (d < 58)),
        repeats / np.maximum(lines, 1),
        size / words / 20,
        2 * share(d <= 32),
    ]
    for k, f in enumerate(forms):
        s = _steps(f)
        for near, weight in ((-1, 0.5), (0, 1.0), (1, 0.5)):
            at = np.clip(s + near, 0, STEPS - 1)
            out[np.arange(n), TRIGRAMS + k * STEPS + at] += weight
    return out


def blocks(texts: Texts) -> Iterator[Texts]:
    for i in range(0, len(texts), ROWS):
        off = texts.off[i:i + ROWS + 1]
        yield Texts(texts.data[off[0]:off[-1]], off - off[0])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(documents that have each term, documents), over all rows; one row a term and task is summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            col = batch.column(0)
            for i, j in cuts(np.diff(texts_of(col).off), CHUNK_BYTES):
                for part in blocks(texts_of(col.slice(i, j - i))):
                    df += (terms(part) > 0).sum(0)
                    n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, n))], ["term", "n"])

    rows = dict(map(tuple, docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()))
    flat = np.array([rows.get(i, 0) for i in range(TERMS + 1)], np.int64)
    return flat[:-1], int(flat[-1])


class Classifier:
    """Term weights, the projection to the latent space, and the labelled vectors."""

    def __init__(self, df: np.ndarray, n: int, rows: np.ndarray, labels: np.ndarray):
        self.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
        self.idf[TRIGRAMS:] = FORM_WEIGHT * np.minimum(self.idf[TRIGRAMS:], 2) / 2
        self.labels = labels.astype(np.float32)
        x = rows * self.idf
        rank = min(LATENT, *x.shape) if len(x) else 1
        self.axes = leading_axes(x, rank) if len(x) else np.zeros((TERMS, 1), np.float32)
        self.vectors = self.embed(rows)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 in the votes of the nearest labelled vectors, by exact cosines."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cos = self.embed(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3) ** POWER
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1).astype(np.float64)


def leading_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    extra = min(rank + 16, *x.shape)
    q = np.random.RandomState(11).standard_normal((x.shape[1], extra)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learn from at most ``sample`` labelled rows that are not held out; document frequencies cover all rows."""
    df, n = document_frequencies(docs)
    learn = (labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
             .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    known = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id")  # at most ``sample`` rows
    dense = map_texts(known, "text", lambda: lambda t: {"terms": pa.array([r.tobytes() for b in blocks(t) for r in terms(b)], pa.binary())},
                      "terms binary", ["doc_id", "quality"])
    rows = dense.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "terms").limit(sample).collect()
    x = np.frombuffer(b"".join(bytes(r["terms"]) for r in rows), np.float32).reshape(-1, TERMS)
    return Classifier(df, n, x, np.array([r["quality"] for r in rows]))


def classify(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``. A null or empty text is scored by its form alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 25 MB: the sample and the space are bounded

    def work():
        def run(texts: Texts) -> dict[str, pa.Array]:
            scores = [shared.value.score(terms(b)) for b in blocks(texts)]
            return {"score": pa.array(np.concatenate(scores) if scores else np.zeros(0))}
        return run

    return map_texts(docs, "text", work, "score double", keep).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    return classify(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
