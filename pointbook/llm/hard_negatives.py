"""Hard-negative mining by segment summaries.

For each anchor the nearest rows of its label are its positives, and the rows
of other labels that score a little less than a positive are its negatives.
Scores are exact inner products of integer vectors.

A vector is cut into segments, and of each only the mean and the deviation are
kept. With m dimensions in a segment, the inner product there is
``m * mean_a * mean_b`` plus that of the centred parts, which is at most
``m * dev_a * dev_b`` either way; the sums over the segments bound the score
from both sides. Pairs that can still matter are bounded anew on finer
segments, and what is left is scored exactly. Nothing is estimated: a pair goes
only if its bound rules it out.

Anchors are handled in groups of at most about ``GROUP`` rows. A group is sent
to all tasks, which pass over the rows in batches and keep the best few for each
anchor, so that memory is bounded by a group and a batch; what tasks keep is
merged by Spark. No row is dealt by label or vector, so a frequent label or a
repeated vector makes no task larger.

Defined results: rows with a null label, id or vector, or with a component that
is null or not finite, take no part. Rows are judged one by one: a repeated row
can be a positive or negative as often as it stands there, but a row of the
anchor's own id never is, and a repeated anchor row gives its results again.
Equal scores come by smaller id. A shorter vector counts as padded with zeros.
An empty table gives no rows. A score beyond ``long`` is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path
from .vectors import EXACT, integer_vectors, matrix, width_of

# Anchors in one broadcast (times the vector's bytes: 16 MB at 64 dimensions), anchors and rows in one block of
# bounds, and rows of a written file.
GROUP, ANCHORS, ROWS, FILE_ROWS = 1 << 15, 1024, 2048, 1 << 13

# Segments at each step of refinement (as far as there are dimensions for them).
LEVELS = (1, 4, 16)

# Above this share of pairs left, whole blocks are multiplied instead of single pairs.
DENSE = 0.05


def cut(width: int, n: int) -> np.ndarray:
    """Where the segments begin, and the end: nested for powers of two."""
    bounds = np.array([0, width])
    for _ in range(ceil(log2(max(n, 1)))):
        bounds = np.unique(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
    return bounds


class Summaries:
    """Of each vector the segments' means and deviations, both times the root of the segment's length."""

    def __init__(self, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.x = x.astype(np.float64)
        self.norm = np.sqrt((self.x ** 2).sum(1))
        self.means, self.devs = [], []
        for n in sorted({len(cut(x.shape[1], n)) - 1 for n in levels if n <= max(x.shape[1], 1)}):
            at = cut(x.shape[1], n)
            size = np.maximum(np.diff(at), 1)
            if x.shape[1]:
                mean = np.add.reduceat(self.x, at[:-1], axis=1) / size
                dev = np.sqrt(np.add.reduceat((self.x - mean.repeat(np.diff(at), axis=1)) ** 2, at[:-1], axis=1) / size)
            else:
                mean = dev = np.zeros((len(x), 1))
            self.means.append(mean * np.sqrt(size))
            self.devs.append(dev * np.sqrt(size))


def bounded(a: Summaries, ai: slice, b: Summaries, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (anchor, row) of ``alive`` that score ``low`` or more and ``high`` or less by their bounds at every level,
    with their exact scores; and the number of pairs that had to be scored. ``low`` and ``high``: by anchor."""
    slack = 1e-9 * a.norm[ai].max(initial=0) * b.norm.max(initial=0) + 1e-6
    pairs = None
    for am, ad, bm, bd in zip(a.means, a.devs, b.means, b.devs):
        am, ad = am[ai], ad[ai]
        if pairs is None:
            mid, reach = am @ bm.T, ad @ bd.T
            alive = alive & (mid + reach + slack >= low[:, None]) & (mid - reach - slack <= high[:, None])
            if np.count_nonzero(alive) < DENSE * alive.size:
                pairs = np.nonzero(alive)
        else:
            i, j = pairs
            mid, reach = (am[i] * bm[j]).sum(1), (ad[i] * bd[j]).sum(1)
            stay = (mid + reach + slack >= low[i]) & (mid - reach - slack <= high[i])
            pairs = i[stay], j[stay]
    if pairs is None:
        i, j = np.nonzero(alive)
        score = (a.x[ai] @ b.x.T)[i, j]
    else:
        i, j = pairs
        score = np.concatenate([np.einsum("ij,ij->i", a.x[ai][i[s:s + 65536]], b.x[j[s:s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
    return i, j, score.astype(np.int64), len(i)


def exact(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``bounded`` for components too large for doubles: all pairs of ``alive``, by whole numbers of any size."""
    i, j = np.nonzero(alive)
    score = np.array([int((a[p].astype(object) * b[q].astype(object)).sum()) for p, q in zip(i, j)] or [0], object)[:len(i)]
    if len(score) and max(abs(s) for s in score) >= 1 << 63:
        raise OverflowError("a score does not fit into a long")
    return i, j, score.astype(np.int64), len(i)


class Best:
    """The first ``k`` (by falling score, then id) for each of ``n`` keys."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(key):
            return
        key, score, vec = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, key))
        key, score, vec = key[order], score[order], vec[order]
        first = np.searchsorted(key, key)  # of each key's run
        top = np.arange(len(key)) - first < self.k
        self.key, self.score, self.vec = key[top], score[top], vec[top]
        full = np.bincount(self.key, minlength=self.n) == self.k
        last = np.searchsorted(self.key, np.arange(self.n), side="right") - 1
        # one double lower, as long scores may be rounded
        self.least = np.where(full, np.nextafter(self.score[last].astype(float), -np.inf), -np.inf)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most ROWS rows."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            yield np.asarray(part.column(0)), np.asarray(part.column(1)), matrix(part.column(2), width)


def _large(a: np.ndarray, b: np.ndarray) -> bool:
    most = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (a, b)]
    return most[0] * most[1] * max(a.shape[1], 1) >= EXACT / 4


class Anchors:
    """A group of anchors: their slots, ids, labels and vectors, by rising slot."""

    def __init__(self, rows: pa.Table, width: int):
        self.slot, self.vec, self.label = (np.asarray(rows.column(c).combine_chunks()) for c in ("slot", "vec_id", "label"))
        self.x, self.width = matrix(rows.column("x"), width), width
        order = np.argsort(self.slot)
        self.slot, self.vec, self.label, self.x = self.slot[order], self.vec[order], self.label[order], self.x[order]


def nearest(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's first ``k`` other rows of the same label for each anchor of the broadcast: (slot, vec_id, score)."""

    def run(batches):
        anchors = sent.value
        a, best = Summaries(anchors.x), Best(len(anchors.slot), k)
        for vec, label, x in _blocks(batches, anchors.width):
            b = Summaries(x)
            for s in range(0, len(anchors.slot), ANCHORS):
                part = slice(s, s + ANCHORS)
                alive = (anchors.label[part, None] == label) & (anchors.vec[part, None] != vec)
                if not alive.any():
                    continue
                low = best.least[part]
                i, j, score, _ = (exact(anchors.x[part], x, alive) if _large(anchors.x[part], x)
                                  else bounded(a, part, b, alive, low, np.full(len(low), np.inf)))
                keep = score >= low[i]
                best.add(i[keep] + s, score[keep], vec[j[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors.slot[best.key]), pa.array(best.vec), pa.array(best.score)], ["slot", "vec_id", "score"])

    return run


def harder(sent, sent_scores, k: int, share: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's first ``k`` rows of other labels for each anchor and positive whose score lies within ``share`` percent
    of the positive's: (slot, nth, vec_id, score). The second broadcast: which positives there are, and their scores."""

    def run(batches):
        anchors, (there, p) = sent.value, sent_scores.value
        a, per = Summaries(anchors.x), p.shape[1]
        best = Best(len(anchors.slot) * per, k)
        # lowest and highest score, as whole numbers: share[0] * p <= 100 * score <= share[1] * p
        wide = p.astype(object)
        floor_ = np.where(there, -(-share[0] * wide // 100), 1).astype(np.int64)
        roof = np.where(there, share[1] * wide // 100, 0).astype(np.int64)
        open_ = there & (floor_ <= roof)
        for vec, label, x in _blocks(batches, anchors.width):
            b = Summaries(x)
            for s in range(0, len(anchors.slot), ANCHORS):
                part = slice(s, s + ANCHORS)
                on = open_[part]
                alive = (anchors.label[part, None] != label) & (anchors.vec[part, None] != vec) & on.any(1)[:, None]
                if not alive.any():
                    continue
                least = best.least.reshape(-1, per)[part]
                low = np.where(on, np.maximum(floor_[part], least), np.inf)
                high = np.where(on, roof[part], -np.inf)
                i, j, score, _ = (exact(anchors.x[part], x, alive) if _large(anchors.x[part], x)
                                  else bounded(a, part, b, alive, low.min(1), high.max(1)))
                for nth in range(per):
                    keep = (score >= low[i, nth]) & on[i, nth] & (score >= floor_[part][i, nth]) & (score <= roof[part][i, nth])
                    best.add((i[keep] + s) * per + nth, score[keep], vec[j[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors.slot[best.key // per]), pa.array(best.key % per), pa.array(best.vec), pa.array(best.score)],
                                         ["slot", "nth", "vec_id", "score"])

    return run


def _first(df: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` of each key by falling score, then id; what a task sent is at most ``k`` a key already."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col(rank) <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), group: int = GROUP) -> DataFrame:
    """Hard negatives of every anchor and positive among ``rows`` (vec_id, label, x array<bigint>).

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, and slot, nth (the
    anchor's row and the positive's place).
    """
    spark = rows.sparkSession
    # Written once, in files small enough to be shared out among all cores; slot names a row for good.
    path = scratch_path(spark, "llm", "hard_negatives")
    src = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "x").where("vec_id is not null and label is not null")
    src = src.withColumn("slot", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    src.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    table = spark.read.schema(src.schema).parquet(path)
    width = width_of(table)
    asked = table.where("anchor")
    n_groups = max(1, -(-asked.count() // group))
    of_group = F.pmod(F.xxhash64("slot"), F.lit(n_groups))
    scanned = table.select("vec_id", "label", "x")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, slot bigint, nth int"
    out_path = scratch_path(spark, "llm", "hard_negatives_found")
    spark.createDataFrame([], schema).write.parquet(out_path)
    for g in range(n_groups):
        # Slots are hashed evenly: a group is near ``group`` rows, whatever the ids are.
        held = Anchors(asked.where(of_group == g).select("slot", "vec_id", "label", "x").toArrow(), width)
        sent = spark.sparkContext.broadcast(held)
        found = _first(scanned.mapInArrow(nearest(sent, positives), "slot bigint, vec_id bigint, score bigint"), ["slot"], positives, "nth").toArrow()
        at = np.searchsorted(held.slot, np.asarray(found.column("slot").combine_chunks()) if found.num_rows else np.zeros(0, np.int64))
        nth = np.asarray(found.column("nth").combine_chunks(), np.int64) - 1 if found.num_rows else at
        there, score, ids = np.zeros((len(held.slot), positives), bool), *np.zeros((2, len(held.slot), positives), np.int64)
        if found.num_rows:
            there[at, nth], score[at, nth], ids[at, nth] = True, *(np.asarray(found.column(c).combine_chunks()) for c in ("score", "vec_id"))
        scores = spark.sparkContext.broadcast((there, score))
        merged = _first(scanned.mapInArrow(harder(sent, scores, negatives, share), "slot bigint, nth bigint, vec_id bigint, score bigint"),
                        ["slot", "nth"], negatives, "rank")

        known = spark.createDataFrame(pa.table({
            "slot": held.slot.repeat(positives), "nth": np.tile(np.arange(positives), len(held.slot)), "anchor_id": held.vec.repeat(positives),
            "positive_id": ids.ravel(), "positive_score": score.ravel()})) if len(held.slot) else spark.createDataFrame([], "slot bigint, nth bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        named = merged.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(known, ["slot", "nth"])
        named.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score", "slot", F.col("nth").cast("int")).write.mode("append").parquet(out_path)
        sent.destroy()
        scores.destroy()
    return spark.read.schema(schema).parquet(out_path)


def report(embeddings: DataFrame, every: int = 50, relabel: int = 7) -> DataFrame:
    """Per anchor (ids divisible by ``every``), positive and rank: the negative and both scores. Where the id is
    divisible by ``relabel``, the label first becomes (label + 1) % 10."""
    rows = integer_vectors(embeddings.select("vec_id", "label", "embedding").where("label is not null"))
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(rows.withColumn("label", moved), F.col("vec_id") % every == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
