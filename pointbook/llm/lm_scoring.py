"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of all documents, share
one vocabulary (every word of the corpus), one order and one smoothing. A
document's score is the mean over its words of the target model's loss minus
the background model's: the lower, the more the document is like the target.

Absolute discounting: a seen bigram has probability
``(c(h,w) - d) / c(h) + b(h) p(w)``, any other ``b(h) p(w)``, with
``b(h) = d * kinds(h) / c(h)`` (1 after an unseen word) and ``p`` add-one
unigrams. Words are 64-bit codes. Neither words nor bigrams are cut.

Words are shuffled once: each occurrence goes to a partition by the word before
it, where that word's counts, the bigram's counts and so its losses are all at
hand; only sums by text come back.

1. Word counts of the corpus, summed in the tasks first.
2. Tasks pack the occurrences of a block of texts for each partition: the
   words before, the words, and the texts by two-byte numbers within the block.
3. The counts of the words that a partition needs are joined to it (a word
   that stands once in the corpus needs none: its one occurrence is at hand).
4. A partition makes its losses and returns, block by block, each text's sums;
   a block's sums and its texts' other columns meet again by block.

A word that is very frequent as the word before is dealt over several
partitions by the word that follows; its totals are summed ahead. Memory is
bounded by a block and by a partition's words, both fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, Texts, cuts, list_array, shuffles_dropped, texts_of, written
from .decontaminate import Words, mix

DISCOUNT = 0.75

# Words that a task counts before it hands counts on, words of a block (and texts, by two-byte numbers), words of a
# partition, and target ids up to which they are broadcast.
COUNTED, BLOCK_WORDS, BLOCK_TEXTS, PARTITION_WORDS, BROADCAST_IDS = 2 << 20, 1 << 20, 1 << 16, 2 << 20, 2_000_000

# The code of what stands before a text's first word, and an odd multiplier.
START, _STEP = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0x9E3779B97F4A7C15)

# Classes of texts: counted in the models or not, scored or not, target or not.
TARGET, SCORED, MODELLED = 1, 2, 4


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(col: pa.Array) -> np.ndarray:
    return np.asarray(col, np.int64).view(np.uint64)


def bigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, words before each text's end)."""
    words = Words(texts)
    before = np.append(START, words.hash[:-1])[:len(words.hash)]
    heads = words.ends[:-1]
    before[heads[heads < len(before)]] = START
    return before, words.hash, words.ends


class Dealing:
    """The partition of each bigram: by the word before, and for a frequent one also by the word."""

    def __init__(self, n: int, frequent: dict[int, int]):
        """``frequent``: into how many partitions a word before is dealt."""
        self.n = n
        self.heads = np.array(sorted(frequent), np.uint64)
        self.into = np.array([frequent[h] for h in sorted(frequent)], np.uint64)

    def of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = mix(h * _STEP) % np.uint64(self.n)
        if len(self.heads):
            k = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
            hot = np.flatnonzero(self.heads[k] == h)
            at[hot] = (at[hot] + mix(w[hot] * _STEP) % self.into[k[hot]]) % np.uint64(self.n)
        return at.astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], text: str = "text", kind: str = "class") -> Iterator[tuple[pa.RecordBatch, np.ndarray, Texts]]:
    """(rows, classes, texts) of about ``CHUNK_BYTES``."""
    for batch in batches:
        col, classes = batch.column(batch.schema.get_field_index(text)), np.asarray(batch.column(batch.schema.get_field_index(kind)))
        for i, j in cuts(np.diff(texts_of(col).off), CHUNK_BYTES):
            yield batch.slice(i, j - i), classes[i:j], texts_of(col.slice(i, j - i))


def _sliced(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that no other process holds all of it at once."""
    for s in range(0, batch.num_rows, rows):
        yield batch.slice(s, rows)


def _sums(keys: tuple[np.ndarray, ...], flags: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Distinct keys, and the sums of the flags for each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [*(k[first] for k in keys), *(np.add.reduceat(f[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for f in flags)]


def _word_counts(src: DataFrame) -> DataFrame:
    """(w, n, t, m): how often each word stands in the modelled texts, in the target ones of them, and in all; START counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            got = _sums((np.concatenate([x[0] for x in held]),), tuple(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)))
            return pa.RecordBatch.from_arrays([_signed(got[0]), *(pa.array(x) for x in got[1:])], ["w", "n", "t", "m"])

        for _, classes, texts in _texts(batches):
            words = Words(texts)
            each = np.diff(words.ends)
            some = classes[each > 0]
            of = np.concatenate([classes.repeat(each), some])
            counted = (of & MODELLED) > 0
            held.append((np.concatenate([words.hash, np.full(len(some), START)]), counted, counted & ((of & TARGET) > 0), np.ones(len(of), bool)))
            size += len(of)
            if size > COUNTED:
                yield from _sliced(out())
                held, size = [], 0
        if size:
            yield from _sliced(out())

    sent = src.select("text", "class").mapInArrow(run, "w bigint, n bigint, t bigint, m bigint")
    return sent.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n", "t", "m")))


def _head_totals(src: DataFrame, heads: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """For each frequent word before: (words after it in all, in target texts, kinds of them in all, in target texts)."""
    shared = src.sparkSession.sparkContext.broadcast(heads)  # at most as many as partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held, size = shared.value, [], 0

        def out():
            got = _sums(tuple(np.concatenate([x[i] for x in held]) for i in (0, 1)), tuple(np.concatenate([x[i] for x in held]) for i in (2, 3)))
            return pa.RecordBatch.from_arrays([_signed(got[0]), _signed(got[1]), pa.array(got[2]), pa.array(got[3])], ["h", "w", "n", "t"])

        for _, classes, texts in _texts(batches):
            h, w, ends = bigrams(texts)
            of = classes.repeat(np.diff(ends))
            mine = np.isin(h, heads) & ((of & MODELLED) > 0)
            h, w, of = h[mine], w[mine], of[mine]
            held.append((h, w, np.ones(len(h), bool), (of & TARGET) > 0))
            size += len(h)
            if size > COUNTED // 2:
                yield from _sliced(out())
                held, size = [], 0
        if size:
            yield from _sliced(out())

    pairs = src.select("text", "class").mapInArrow(run, "h bigint, w bigint, n bigint, t bigint").groupBy("h", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = pairs.groupBy("h").agg(F.sum("n"), F.sum("t"), F.count(F.lit(1)), F.sum((F.col("t") > 0).cast("bigint"))).collect()
    return {int(np.int64(r[0]).view(np.uint64)): tuple(r[1:]) for r in rows}


def _needed(src: DataFrame, dealing, told: DataFrame) -> DataFrame:
    """(p, w, n, t): the words of ``told`` that stand in each partition, with their counts.

    A task sends each of its words once with all the partitions that need it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            w, p = _sums(tuple(np.concatenate([x[i] for x in held]) for i in (1, 0)), ())
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[:len(w)])
            return pa.RecordBatch.from_arrays([_signed(w[first]), list_array(pa.array(p, pa.int32()), np.append(first, len(w)))], ["w", "ps"])

        for _, _, texts in _texts(batches):
            h, w, _ = bigrams(texts)
            held.append((dealing.value.of(h, w), w))
            size += len(w)
            if size > COUNTED:
                yield from _sliced(out())
                held, size = [], 0
        if size:
            yield from _sliced(out())

    # rows of a word meet first, so that the same partitioning serves the join and the distinct
    sent = src.select("text", "class").mapInArrow(run, "w bigint, ps array<int>").repartition("w")
    return sent.join(told, "w").select(F.explode("ps").alias("p"), "w", "n", "t").distinct()


def _pack(h: np.ndarray, w: np.ndarray, text: np.ndarray, borders: np.ndarray) -> bytes:
    """Occurrences (sorted by h, then w) of a block: runs of h, runs of w within, and the texts; ``borders``: where the
    texts of each class begin."""
    new_h = np.append(True, h[1:] != h[:-1])
    new_w = new_h | np.append(True, w[1:] != w[:-1])
    at_w = np.flatnonzero(new_w)
    runs = np.diff(np.append(at_w, len(h)))
    kinds = np.diff(np.append(np.flatnonzero(new_h[at_w]), len(at_w)))
    small = runs.max() < 256
    head = np.array([len(kinds), len(at_w), len(h), small, *borders], np.int64)
    return b"".join([head.tobytes(), h[new_h].tobytes(), w[at_w].tobytes(), kinds.astype(np.uint32).tobytes(), runs.astype(np.uint8 if small else np.uint32).tobytes(),
                     text.astype(np.uint16).tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before and word of each distinct bigram, its occurrences, the text of each occurrence, the class borders)."""
    head = np.frombuffer(blob, np.int64, 13)
    n_h, n_w, n, small = (int(x) for x in head[:4])
    at = head.nbytes

    def take(kind, count):
        nonlocal at
        got = np.frombuffer(blob, kind, count, at)
        at += got.nbytes
        return got

    heads, w, kinds = take(np.uint64, n_h), take(np.uint64, n_w), take(np.uint32, n_h)
    runs = take(np.uint8 if small else np.uint32, n_w).astype(np.int64)
    return heads.repeat(kinds), w, runs, take(np.uint16, n), head[4:]


def _occurrences(src: DataFrame, dealing, schema: T.StructType) -> DataFrame:
    """Packed occurrences for each partition and block, and each scored text's other columns with its number in the block."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, block = dealing.value, TaskContext.get().partitionId() << 24
        held, size, count = [], 0, 0

        def out():
            classes = np.concatenate([x[1] for x in held])
            number = np.empty(len(classes), np.int64)  # texts by class, so that borders tell the classes
            number[np.argsort(classes, kind="stable")] = np.arange(len(classes))
            borders = np.searchsorted(np.sort(classes), np.arange(9))
            each = np.concatenate([x[4] for x in held])
            scored = np.flatnonzero(classes & SCORED)
            if len(scored):
                rows = pa.concat_arrays([x[0] for x in held]).take(pa.array(scored))
                none = [pa.nulls(len(scored), pa.binary())] + [pa.nulls(len(scored), pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scored), block % deal.n), pa.int32()), pa.array(np.full(len(scored), block)), pa.array(number[scored], pa.int32()),
                                                  pa.array(each[scored]), rows, *none], names)
            h, w = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            if not len(h):
                return
            text = number.repeat(each)
            p = deal.of(h, w)
            order = np.lexsort((w, h, p))
            h, w, text, p = h[order], w[order], text[order], p[order]
            cut = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
            blobs = [_pack(h[a:b], w[a:b], text[a:b], borders) for a, b in zip(cut, cut[1:])]
            k = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(p[cut[:-1]], pa.int32()), pa.array(np.full(k, block)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, row_arrow),
                                              pa.array(blobs, pa.binary()), *[pa.nulls(k, pa.int64())] * 3], names)

        for batch, classes, texts in _texts(batches):
            row_arrow = batch.schema.field("row").type
            h, w, ends = bigrams(texts)
            for i in range(0, len(classes), BLOCK_TEXTS // 2):  # a chunk of very many short texts
                j = min(i + BLOCK_TEXTS // 2, len(classes))
                if held and (size + ends[j] - ends[i] > BLOCK_WORDS or count + j - i > BLOCK_TEXTS):
                    yield from out()
                    held, size, count, block = [], 0, 0, block + 1
                held.append((batch.column(batch.schema.get_field_index("row")).slice(i, j - i), classes[i:j], h[ends[i]:ends[j]], w[ends[i]:ends[j]], np.diff(ends[i:j + 1])))
                size, count = size + int(ends[j] - ends[i]), count + j - i
        if held:
            yield from out()

    return src.mapInArrow(run, schema)


class Totals:
    """What all partitions know: words in each model, distinct words (and the unknown one), the totals of the frequent
    words before, and whether a word without a count stands once (or, in texts that are not modelled, never)."""

    def __init__(self, n: int, t: int, size: int, heads: dict[int, tuple[int, int, int, int]], once: bool):
        self.n, self.t, self.size, self.once = n, t, size, once
        self.codes = np.array(sorted(heads), np.uint64)
        self.heads = np.array([heads[h] for h in sorted(heads)], np.float64).reshape(-1, 4)


def _losses(h: np.ndarray, w: np.ndarray, n: np.ndarray, t: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """(target, background) losses of a partition's distinct bigrams, sorted by h, then w, with their counts."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    of_head = np.stack([np.add.reduceat(x.astype(np.float64), first) for x in (n, t, n > 0, t > 0)], axis=1)
    if len(totals.codes):  # heads that have other words elsewhere
        k = np.minimum(np.searchsorted(totals.codes, h[first]), len(totals.codes) - 1)
        hot = totals.codes[k] == h[first]
        of_head[hot] = totals.heads[k[hot]]
    codes, uni_n, uni_t = words
    k = np.minimum(np.searchsorted(codes, w), max(len(codes) - 1, 0))
    known = np.flatnonzero(codes[k] == w) if len(codes) else np.zeros(0, np.int64)
    k = k[known]

    def loss(c, tot, kinds, uni, total):
        # one model after the other, so that only one's arrays are held
        backed = c.astype(np.float64) if totals.once else np.zeros(len(w))  # of a word without a count
        backed[known] = uni[k]
        held = np.maximum(tot, 1.0)
        backed += 1
        backed *= (np.where(tot > 0, np.maximum(1 - (tot - DISCOUNT * kinds) / held, 1e-12), 1.0) / float(total + totals.size)).repeat(size)
        backed += np.where(c > 0, (c - DISCOUNT) / held.repeat(size), 0.0)
        return -np.log(backed)

    return (loss(t, of_head[:, 1], of_head[:, 3], uni_t, totals.t), loss(n, of_head[:, 0], of_head[:, 2], uni_n, totals.n))


def _sum_losses(shared):
    """A partition's rows (packed occurrences, counts of its words, columns of texts) to sums by block and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, blobs, words, kind = shared.value, [], [], None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kind = col["row"].type
            packed, counted = col["blob"].is_valid(), col["w"].is_valid()
            there = np.flatnonzero(np.asarray(packed))
            blobs += zip(np.asarray(col["b"].take(pa.array(there))).tolist(), (x.as_py() for x in col["blob"].take(pa.array(there))))
            there = pa.array(np.flatnonzero(np.asarray(counted)))
            words.append((_unsigned(col["w"].take(there)), *(np.asarray(col[c].take(there), np.float64) for c in ("n", "t"))))
            rest = pa.array(np.flatnonzero(~np.asarray(packed) & ~np.asarray(counted)))
            if len(rest):
                yield pa.RecordBatch.from_arrays([col[c].take(rest) for c in ("b", "number", "n_words", "row")] + [pa.nulls(len(rest), pa.binary())], OUT)
        if not blobs:
            return
        codes, un, ut = (np.concatenate([x[i] for x in words]) for i in range(3))
        order = np.argsort(codes)
        parts = [_unpack(blob) for _, blob in blobs]
        h, w, runs = (np.concatenate([x[i] for x in parts]) for i in range(3))
        counts = []
        for bit in (MODELLED, MODELLED | TARGET):
            part = []
            for _, _, run_, text, borders in parts:
                flag = np.array([c & bit == bit for c in range(8)])[np.searchsorted(borders, text, side="right") - 1] if len(text) else np.zeros(0, bool)
                part.append(np.add.reduceat(flag.astype(np.int32), np.cumsum(run_) - run_))
            counts.append(np.concatenate(part))
        by = np.lexsort((w, h))
        hs, ws = h[by], w[by]
        new = np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))
        first = np.flatnonzero(new)
        got = _losses(hs[first], ws[first], *(np.add.reduceat(c[by], first) for c in counts), (codes[order], un[order], ut[order]), totals)
        place = np.empty(len(h), np.int32)
        place[by] = np.cumsum(new, dtype=np.int32) - 1
        del hs, ws, by, h, w, new, counts
        blocks, sums, at = [], [], 0
        for (block, _), (_, _, run_, text, borders) in zip(blobs, parts):
            each = place[at:at + len(run_)].repeat(run_)
            at += len(run_)
            n = int(borders[-1])
            total = [np.bincount(text, x[each], n) for x in got]
            seen = np.flatnonzero(np.bincount(text, minlength=n))
            seen = seen[np.array([c & SCORED > 0 for c in range(8)])[np.searchsorted(borders, seen, side="right") - 1]]
            if len(seen):
                blocks.append(block)
                sums.append(seen.astype(np.uint16).tobytes() + b"".join(x[seen].astype(np.float32).tobytes() for x in total))
        if blocks:
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, kind), pa.array(sums, pa.binary())], OUT)

    return run


OUT = ["b", "number", "n_words", "row", "blob"]
NAMES = ("n_words", "target_loss", "background_loss", "score")


def _means(table: pa.Table) -> pa.Table:
    """A block's texts with the means of their losses."""
    packed = np.asarray(table.column("blob").combine_chunks().is_valid())
    rows = table.filter(pa.array(~packed))
    sums = np.zeros((2, BLOCK_TEXTS))
    for blob in table.column("blob").filter(pa.array(packed)).to_pylist():
        n = len(blob) // 10
        text = np.frombuffer(blob, np.uint16, n)
        for k in range(2):
            sums[k, text] += np.frombuffer(blob, np.float32, n, 2 * n + 4 * n * k)
    number, n = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("number", "n_words"))
    target, background = sums[:, number] / np.maximum(n, 1)
    return pa.table([rows.column("row"), pa.array(n), pa.array(target), pa.array(background), pa.array(target - background)], ["row", *NAMES])


def score(docs: DataFrame, target_ids: DataFrame, keep: list[str] | None = None, background: DataFrame | None = None) -> DataFrame:
    """Add ``n_words``, ``target_loss``, ``background_loss`` and ``score`` (their difference), means over the text's words.

    The models are of ``background`` (doc_id, text; ``docs`` itself by default)
    and of those of its rows whose doc_id is in ``target_ids``. A null or
    empty text, or one without words, has 0 in all. Repeated rows are counted
    and scored each; a null doc_id is no target. Target ids are broadcast up to
    ``BROADCAST_IDS``, counted first; beyond, documents are joined by id.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    ids = target_ids.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def marked(df: DataFrame, row, bits: int) -> DataFrame:
        held = df.select(row.alias("row"), F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        flag = F.when(F.col("target_id").isNotNull(), F.lit(bits | TARGET)).otherwise(F.lit(bits))
        return held.join(ids, F.col("_id") == F.col("target_id"), "left").select("row", "text", flag.cast("int").alias("class"))

    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(True).alias("_"))
    src = marked(docs, row, SCORED | MODELLED if background is None else SCORED)
    if background is not None:
        src = src.unionByName(marked(background, F.lit(None).cast(src.schema["row"].dataType), MODELLED))

    with shuffles_dropped(spark):
        counts = written(_word_counts(src), "words")
    code = int(START.view(np.int64))
    words = counts.where(F.col("w") != code)
    size, n, t, all_ = words.agg(F.sum((F.col("n") > 0).cast("bigint")), F.sum("n"), F.sum("t"), F.sum("m")).first()
    parts = max(1, -(-(all_ or 0) // PARTITION_WORDS))
    # at most ``parts`` of them
    frequent = {int(np.int64(r.w).view(np.uint64)): -(-r.m // PARTITION_WORDS) for r in counts.where(F.col("m") > PARTITION_WORDS).collect()}
    frequent = {h: min(k, parts) for h, k in frequent.items()}
    dealing = spark.sparkContext.broadcast(Dealing(parts, frequent))
    heads = _head_totals(src, np.array(sorted(frequent), np.uint64)) if frequent else {}
    totals = spark.sparkContext.broadcast(Totals(n or 0, t or 0, (size or 0) + 1, heads, background is None))

    own = T.StructField("row", src.schema["row"].dataType)  # packed rows have none
    schema = T.StructType([*T.StructType.fromDDL("p int, b bigint, number int, n_words bigint").fields, own,
                           *T.StructType.fromDDL("blob binary, w bigint, n bigint, t bigint").fields])
    # a word that stands once is counted where it stands
    told = words.where("n > 1") if background is None else words.where("n > 0")
    needed = _needed(src, dealing, told.select("w", "n", "t"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields}
    needed = needed.select(*(F.col(c) if c in ("p", "w", "n", "t") else empty[c] for c in schema.names))
    dealt = _occurrences(src, dealing, schema).unionByName(needed).repartitionById(parts, F.col("p"))
    kinds = T.StructType([*T.StructType.fromDDL("b bigint, number int, n_words bigint").fields, own, *T.StructType.fromDDL("blob binary").fields])
    summed = dealt.mapInArrow(_sum_losses(totals), kinds)
    result = T.StructType([own, *T.StructType.fromDDL("n_words bigint, target_loss double, background_loss double, score double").fields])
    done = summed.groupBy("b").applyInArrow(_means, result)
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), *NAMES)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, target_loss, background_loss, score; the target is the documents labelled of good quality."""
    return score(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"), ["doc_id"])
