"""Removal of long byte strings that an earlier document holds, by external suffix arrays.

Each 50-byte window of a text has a key: the least hash of the 16-byte strings
in it. Equal windows have equal keys, so windows dealt to shards by key meet
all their equals. Neighbouring windows mostly share a key; such a run is one
segment of text, and equal segments travel once from each task. A filter
first leaves out windows which no other document can have: the hashed string
with its left or right surroundings occurs nowhere else. It is no table that
tasks look into, which would fill up or grow with the input: each chunk of
texts sends its hashes, dealt by range, and gets back one bit for each. Every
shard's segments are sorted by an external induced suffix array, in which
equal windows are neighbours that share 50 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, binary_array, cuts, list_array, shuffles_dropped, texts_of, written
from .suffix_array import Store, suffixes_descending

# Bytes of the hashed strings in a window.
GRAM = 16

# Text that one vectorised pass holds, so that its arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 17

# Text whose hashes are sent and answered together (2^16 rows at most), and text for each range of the hashes (some 9 bytes a hash).
DEALT_BYTES = 2 << 20
RANGE_BYTES = 16 << 20

# Bits of the filter that tells documents with something to remove from others (2 MB broadcast).
DOC_BITS = 24

# The most windows of a segment, so that a long repetition is many equal segments.
MOST_WINDOWS = 206

# Input text for each shard; its segments hold about as much (a shard of any size is sorted, on disk beyond memory).
SHARD_BYTES = 8 << 20

# Segments that a task gathers, distinct ones and occurrences, before it passes them on, and distinct ones that it sends at a time.
GATHERED = 200_000
GATHERED_PLACES = 1_000_000
SENT = 20_000

_TABLE = np.random.RandomState(7).randint(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 31) - 1)  # low bits that hold a position, the smaller the further left


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each position."""
    h, power, size = _TABLE[data], _STEP, 1
    while size < GRAM:  # hashes of strings twice as long
        h = h[:-size] * power + h[size:]
        power, size = power * power, 2 * size
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """The windows of a run of texts in pieces: those with the same least gram, before and after its middle.

    ``row``, ``first``, ``size``: the text, first byte and number of windows;
    ``key``: the gram's hash; ``wide``: the hash of the gram with what lies to
    its left (or right) in all the piece's windows. Equal windows have equal
    grams at equal places, the leftmost of the least, so both hashes are equal.
    """

    def __init__(self, texts: Texts, width: int):
        n = len(texts.data) - width + 1
        empty = np.zeros(0, np.int64)
        self.row = self.first = self.size = empty
        self.key = self.wide = empty.astype(np.uint64)
        if n < 1:
            return
        grams = width - GRAM + 1
        half, near = grams // 2, min(grams // 2, GRAM)
        with np.errstate(over="ignore"):
            h = gram_hashes(texts.data)
            least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= grams:  # minima over spans twice as long
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[:n], least[grams - span:grams - span + n])
            new = np.append(True, least[1:] != least[:-1])
            heads = texts.off[:-1]
            new[heads[heads < n]] = True
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, n))
            # windows that reach over the end of their text are left out
            size = np.minimum(size, texts.off[np.minimum(texts.row_of(at) + 1, len(texts))] - width + 1 - at)
            at, size = at[size > 0], size[size > 0]
            place = (least[at] & _PLACE).astype(np.int64)
            left = np.clip(place - half - at + 1, 0, size)
            own = h[place]
            before = _mixed(h[np.maximum(place - half, 0)] * _STEP + h[np.maximum(place - near, 0)] * _TABLE[1] + own)
            last = len(h) - 1
            after = _mixed(h[np.minimum(place + half, last)] * _TABLE[2] + h[np.minimum(place + near, last)] * _TABLE[3] + own)
        both = np.stack([left, size - left], 1).reshape(-1)
        use = both > 0
        self.size = both[use]
        self.first = np.stack([at, at + left], 1).reshape(-1)[use]
        self.wide = np.stack([before, after], 1).reshape(-1)[use]
        self.key = own.repeat(2)[use]
        self.row = texts.row_of(self.first)

    @classmethod
    def of(cls, col: pa.Array, width: int) -> Pieces:
        """Those of a column of texts, found in runs of CHUNK_BYTES; rows and first bytes are the column's."""
        off = texts_of(col).off
        each = [(i, cls(texts_of(col.slice(i, j - i)), width)) for i, j in cuts(np.diff(off), CHUNK_BYTES)]
        out = cls(texts_of(col.slice(0, 0)), width)
        if each:
            out.row = np.concatenate([p.row + i for i, p in each])
            out.first = np.concatenate([p.first + off[i] for i, p in each])
            for name in ("size", "key", "wide"):
                setattr(out, name, np.concatenate([getattr(p, name) for _, p in each]))
        return out

    def joined(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte, windows, key) of the used pieces, those of one key that follow each other as one segment."""
        row, first, size, key = self.row[use], self.first[use], self.size[use], self.key[use]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (first[1:] != first[:-1] + size[:-1])
        at = np.flatnonzero(new)
        size = np.add.reduceat(size, at) if len(at) else size
        row, first, key = row[at], first[at], key[at]
        parts = -(-size // MOST_WINDOWS)
        step = MOST_WINDOWS * (np.arange(int(parts.sum())) - (np.cumsum(parts) - parts).repeat(parts))
        return row.repeat(parts), first.repeat(parts) + step, np.minimum(size.repeat(parts) - step, MOST_WINDOWS), key.repeat(parts)


def _new(x: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _ranges(spot: np.ndarray, parts: int) -> np.ndarray:
    """The range, of ``parts`` equal ones, that each 48-bit hash lies in."""
    return ((spot >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """The rows (doc, text_id, body) of a task in chunks, each with an id: its place among them and its content."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for i, j in cuts(np.diff(texts_of(batch.column(2)).off) + (DEALT_BYTES >> 16), DEALT_BYTES):
            rows = batch.slice(i, j - i)
            texts = texts_of(rows.column(2))
            of = xxhash.xxh3_128(b"%d,%d" % (part, n))
            for x in (np.asarray(rows.column(0)), texts.off, texts.data):
                of.update(np.ascontiguousarray(x))
            n += 1
            yield of.digest(), rows


def _sent(chunk: bytes, col: pa.Array, width: int, parts: int) -> pa.RecordBatch:
    """A chunk's distinct hashes in order, by range: 31 bits each, and one more if two rows have it."""
    got = Pieces.of(col, width)
    pair = np.sort(got.wide >> np.uint64(16) << np.uint64(16) | got.row.astype(np.uint64))
    spot = pair[_new(pair)] >> np.uint64(16)
    new = _new(spot)
    many = np.append(~new[1:], False)[new]
    spot = spot[new]
    part = _ranges(spot, parts)
    raw = (spot & np.uint64(0x7FFFFFFF) | many.astype(np.uint64) << np.uint64(31)).astype("<u4").view(np.uint8)
    at = np.flatnonzero(_new(part))
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(at), pa.binary()), pa.array(part[at]), binary_array(raw, np.append(at, len(part)) * 4)], ["chunk", "part", "spots"])


def _answered(chunks: list[bytes], spots: list[np.ndarray], part: int) -> pa.RecordBatch:
    """For what the chunks sent of one range: a bit for each hash, set if two rows have it."""
    ends = np.cumsum([0, *map(len, spots)])
    all_ = np.concatenate(spots)
    order = np.sort((all_ & np.uint32(0x7FFFFFFF)).astype(np.uint64) << np.uint64(32) | np.arange(len(all_), dtype=np.uint64))
    at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = np.flatnonzero(~_new(order >> np.uint64(32)))
    met = all_ >> np.uint32(31) > 0
    met[at[same]] = met[at[same - 1]] = True
    bits = [np.packbits(met[a:b], bitorder="little").tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array([part] * len(chunks), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "part", "bits"])


def _met(got: Pieces, parts: int, bits: dict[int, bytes]) -> np.ndarray:
    """Which pieces of a chunk another row may have: all those of a range without an answer."""
    spot = got.wide >> np.uint64(16)
    order = np.argsort(spot)
    spot = spot[order]
    new = _new(spot)
    part = _ranges(spot[new], parts)
    met = np.ones(len(part), bool)
    at = np.flatnonzero(_new(part))
    for p, a, b in zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)]):
        if len(known := bits.get(p, b"")) == b - a + 7 >> 3:
            met[a:b] = np.unpackbits(np.frombuffer(known, np.uint8), count=b - a, bitorder="little")
    use = np.empty(len(order), bool)
    use[order] = met[np.cumsum(new) - 1]
    return use


def answers(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(chunk, part, bits): of the hashes that a chunk has in a range, in order, which ones two or more rows have.

    ``rows`` has doc, text_id and body. Two different hashes of a range in
    2^31 can count as one; that only adds work.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, some in _chunks(batches):
            yield _sent(chunk, some.column(2), width, parts)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunks, spots = None, [], []
        for batch in batches:
            for p, chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if chunks:
                        yield _answered(chunks, spots, part)
                    part, chunks, spots = p, [], []
                chunks.append(chunk)
                spots.append(np.array(np.frombuffer(raw.as_buffer(), "<u4")))
        if chunks:
            yield _answered(chunks, spots, part)

    sent = rows.select("doc", "text_id", "body").mapInArrow(send, "chunk binary, part int, spots binary").select("part", "chunk", "spots")
    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(answer, "chunk binary, part int, bits binary")


def _places(known: dict[bytes, int], own: np.ndarray, key: np.ndarray, where: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task has gathered, a row for each occurrence; a segment's first one carries it, its shard, and its least and largest doc."""
    order = np.argsort(own, kind="stable")
    doc, text_id, place = (x[order] for x in where)
    start = np.flatnonzero(_new(own[order]))
    count = np.diff(np.append(start, len(own)))
    least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    shard = (key[order[start]] >> np.uint64(33)).astype(np.int32)
    each = iter(known)
    for a in range(0, len(start), SENT):  # in parts: the tasks' memory adds up
        bodies = list(islice(each, SENT))
        b = a + len(bodies)
        half = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, bodies)), np.int64).reshape(-1, 2).repeat(count[a:b], axis=0)
        here = slice(int(start[a]), int(start[a]) + len(half))
        first = pa.array(np.arange(len(bodies)).repeat(count[a:b]), mask=~np.isin(np.arange(here.start, here.stop), start[a:b]))
        yield pa.RecordBatch.from_arrays([
            pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(doc[here]), pa.array(text_id[here]), pa.array(place[here]),
            *(pa.array(x[a:b]).take(first) for x in (least, most, shard)), pa.array(bodies, pa.binary()).take(first)],
            ["id1", "id2", "doc", "text_id", "place", "least", "most", "shard", "body"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, dict[int, bytes]]]:
    """The texts of each chunk, in any order, and what it was answered, of rows (chunk, doc, text_id, body, part, bits) by chunk."""
    chunk, texts, answer = None, [], {}

    def whole():
        docs, text_ids, bodies = (c.combine_chunks() for c in pa.Table.from_batches(texts).columns)
        return np.asarray(docs), np.asarray(text_ids), bodies, answer

    for batch in batches:
        ids = batch.column(0).to_pylist()
        heads = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        for i, j in zip(heads, [*heads[1:], len(ids)]):
            if ids[i] != chunk:
                if texts:
                    yield whole()
                chunk, texts, answer = ids[i], [], {}
            some = batch.slice(i, j - i)
            text = pc.is_null(some.column(4))
            texts.append(some.select([1, 2, 3]).filter(text))
            bits = some.select([4, 5]).filter(pc.invert(text))
            answer.update(zip(*(c.to_pylist() for c in bits.columns)))
    if texts:
        yield whole()


def found(rows: DataFrame, width: int, bits: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Segments whose windows other rows may have, of rows (doc, text_id, body): a row for each occurrence.

    ``bits`` are the rows' ``answers``. A chunk without any, as its rows were read in another order then, passes whole.
    """
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, some in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.binary()), *some.columns], ["chunk", "doc", "text_id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held, n = [], 0

        def flushed():
            own, key, *where = (np.concatenate(x) for x in zip(*held))
            yield from _places(known, own, key, where)
            known.clear()
            held.clear()

        for docs, text_ids, bodies, answer in _told(batches):
            got, texts = Pieces.of(bodies, width), texts_of(bodies)
            row, first, size, key = got.joined(_met(got, parts, answer))
            raw = texts.raw()
            own = [known.setdefault(raw[a:b], len(known)) for a, b in zip(first.tolist(), (first + size + width - 1).tolist())]
            held.append((np.array(own, np.int64), key, docs[row], text_ids[row], (first - texts.off[row]) << 8 | size))
            n += len(own)
            if len(known) > GATHERED or n > GATHERED_PLACES:
                yield from flushed()
                n = 0
        if known:
            yield from flushed()

    texts = rows.select("doc", "text_id", "body").mapInArrow(told, "chunk binary, doc bigint, text_id bigint, body binary")
    both = texts.unionByName(bits, allowMissingColumns=True).select("chunk", "doc", "text_id", "body", "part", "bits")
    return (both.repartition(tasks, "chunk").sortWithinPartitions("chunk")
            .mapInArrow(run, "id1 bigint, id2 bigint, doc bigint, text_id bigint, place bigint, least bigint, most bigint, shard int, body binary"))


def least_docs(bodies: list[bytes], docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each body in their joined text, at each window's position there the least doc of its equals)."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    start = np.cumsum(size + 1) - size - 1
    with Store() as store:
        text = store.array(int((size + 1).sum()), np.uint16)
        for i in range(0, len(bodies), 4096):
            part = np.frombuffer(b"".join(bodies[i:i + 4096]), np.uint8)
            s = size[i:i + 4096]
            at = start[i:i + 4096].repeat(s) + np.arange(len(part)) - (np.cumsum(s) - s).repeat(s)
            text[at] = part.astype(np.uint16) + 1  # 0 stands between bodies
        # only whole windows matter: what lies between two equal ones is equal to them; 1 + the body of each
        owner = store.array(len(text), np.int32 if len(bodies) < (1 << 31) - 1 else np.int64)
        windows = size - width + 1
        for i in range(0, len(bodies), 4096):
            w = windows[i:i + 4096]
            owner[start[i:i + 4096].repeat(w) + np.arange(int(w.sum())) - (np.cumsum(w) - w).repeat(w)] = np.arange(i + 1, i + 1 + len(w)).repeat(w)
        group = store.array(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
        best, n, seen, before = [], -1, 0, -1
        for at, shared in suffixes_descending(text, width, store):
            number = seen + np.cumsum(shared < width)
            seen = int(number[-1])
            own = owner[at]
            use = own > 0
            at, number, own = at[use], number[use], own[use]
            if not len(at):
                continue
            new = np.append(number[0] != before, number[1:] != number[:-1])
            before = int(number[-1])
            dense = n + np.cumsum(new)
            n = int(dense[-1])
            group[at] = dense
            value = np.minimum.reduceat(docs[own - 1], np.flatnonzero(np.append(True, new[1:])))
            if not new[0]:
                best[-1][-1] = min(best[-1][-1], value[0])
                value = value[1:]
            if len(value):
                best.append(value)
        best = np.concatenate(best) if best else np.zeros(1, np.int64)
        least = np.zeros(len(text), np.int64)
        for i in range(0, len(text), 1 << 20):
            least[i:i + (1 << 20)] = best[group[i:i + (1 << 20)]]
        return start, least


def _early_runs(bodies: list[bytes], docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first byte, end) of the runs of windows that a doc before the body's least has, by place."""
    if not bodies:
        return (np.zeros(0, np.int64),) * 3
    start, by_window = least_docs(bodies, docs, width)
    windows = np.fromiter(map(len, bodies), np.int64, len(bodies)) - width + 1
    # windows of all bodies in a row, and the runs of those that come earlier elsewhere
    ends = np.cumsum(windows)
    at = start.repeat(windows) + np.arange(int(ends[-1])) - (ends - windows).repeat(windows)
    early = by_window[at] < docs.repeat(windows)
    head = early & ~np.append(False, early[:-1])
    tail = early & ~np.append(early[1:], False)
    head[ends[:-1]] = early[ends[:-1]]
    tail[ends - 1] = early[ends - 1]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    own = np.searchsorted(ends, a, side="right")
    base = (ends - windows)[own]
    return own, a - base, b - base + width


def _judge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of a shard's segments: least doc of each, and the runs of windows that an even earlier doc has.

    Equal windows have equal keys: a segment that is the only one of its key, once equal ones are one, has
    no window of another and needs no sorting.
    """
    known: dict[bytes, int] = {}
    least, most, keys, bodies = [], [], [], []
    for batch in batches:
        for lo, hi, key, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
            at = known.setdefault(b, len(bodies))
            if at == len(bodies):
                least.append(lo)
                most.append(hi)
                keys.append(key)
                bodies.append(b)
            else:
                least[at], most[at] = min(least[at], lo), max(most[at], hi)
    if not bodies:
        return
    known.clear()
    docs = np.array(least, np.int64)
    _, of_key, count = np.unique(np.array(keys, np.int64), return_inverse=True, return_counts=True)
    met = np.flatnonzero(count[of_key] > 1)
    own, a, b = _early_runs([bodies[k] for k in met.tolist()], docs[met], width)
    of = np.searchsorted(met[own], np.arange(len(bodies) + 1))
    held = (np.array(most, np.int64) > docs) | (of[:-1] < of[1:])
    spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"])
    for i in range(0, len(bodies), 10_000):
        j = min(len(bodies), i + 10_000)
        keep = i + np.flatnonzero(held[i:j])  # the others have no spans
        half = np.frombuffer(b"".join(xxhash.xxh3_128_digest(bodies[k]) for k in keep.tolist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(docs[keep]),
            list_array(spans.slice(of[i], of[j] - of[i]), np.append(of[keep], of[j]) - of[i])], ["id1", "id2", "least", "spans"])


def removed(rows: DataFrame, width: int = 50) -> DataFrame:
    """Per (doc, text_id): ``cut``, the maximal byte spans (a, b) to remove, by place; texts without any are left out.

    ``rows`` has doc (bigint, no nulls), text_id (bigint) and body (binary, no nulls).
    """
    if width < 2 * GRAM or width > 254:
        raise ValueError(f"width must be from {2 * GRAM} to 254")
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts, shards = max(1, -(-total // RANGE_BYTES)), max(1, -(-total // SHARD_BYTES))
    with shuffles_dropped(rows.sparkSession):
        bits = written(answers(rows, width, parts), "answers")
        at = written(found(rows, width, bits, parts, shards), "segments")
        bodies = at.where(F.col("body").isNotNull()).select("least", "most", "shard", "body")
        judged = written(bodies.repartition(shards, "shard").select("least", "most", "shard", "body")
                         .mapInArrow(lambda it: _judge(it, width), "id1 bigint, id2 bigint, least bigint, spans array<struct<a:int,b:int>>"), "judged")
    at = at.select("id1", "id2", "doc", "text_id", "place")
    start, windows = F.shiftright("place", 8).cast("int"), F.col("place").bitwiseAND(255).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("a"), (windows + width - 1).alias("b")))
    spans = (at.join(judged, ["id1", "id2"]).select("doc", "text_id", start.alias("start"), F.explode(F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("spans"))).alias("s"))
             .groupBy("doc", "text_id", (F.col("start") + F.col("s.a")).alias("a")).agg(F.max(F.col("start") + F.col("s.b")).alias("b")))
    # overlapping and touching spans of a text become one
    by_place = Window.partitionBy("doc", "text_id").orderBy("a")
    fresh = F.coalesce(F.col("a") > F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "text_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("doc", "text_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cut"))


def _doc_slot(doc: Column, text_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc, text_id), F.lit(1 << DOC_BITS))


def _touched(cut: DataFrame) -> np.ndarray:
    """One bit a slot, set if a row of ``cut`` falls into it: 2^(DOC_BITS - 6) words at most."""
    word = F.shiftright("slot", 6)
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = cut.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << DOC_BITS - 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def dedup(docs: DataFrame, width: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Add ``body`` (the text's bytes), ``cut`` (spans removed from it) and ``kept`` (the remaining bytes).

    A byte is removed if a ``width``-byte string over it also starts in a
    document with a smaller doc_id, judged on the input. A null text is
    empty. A null doc_id is larger than any other. Rows with the same doc_id
    do not remove from each other. The documents are read several times;
    those with something to remove are shuffled once, to meet their spans.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("body", "cut", "kept")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(text).alias("text_id"), F.encode(text, "UTF-8").alias("body"))
    # documents that surely have nothing to remove need not meet the spans
    with shuffles_dropped(docs.sparkSession):
        cut = written(removed(rows, width).withColumn("slot", _doc_slot(F.col("doc"), F.col("text_id"))), "spans")
    touched = docs.sparkSession.sparkContext.broadcast(_touched(cut))

    @F.pandas_udf("boolean")
    def may_have(slot: pd.Series) -> pd.Series:
        at = slot.to_numpy(np.int64)
        return pd.Series((touched.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    rows = rows.withColumn("touched", may_have(_doc_slot(F.col("doc"), F.col("text_id"))))
    cut = cut.select(F.col("doc").alias("of_doc"), F.col("text_id").alias("of_text"), "cut")
    some = rows.where("touched").join(cut, (F.col("doc") == F.col("of_doc")) & (F.col("text_id") == F.col("of_text")), "left")
    done = some.select("row", "body", "cut").unionByName(rows.where("not touched").select("row", "body", F.lit(None).cast("array<struct<a:int,b:int>>").alias("cut")))
    end = F.octet_length("body")
    # what lies between the removed spans
    rest = F.transform(F.concat("cut", F.array(F.struct(end.alias("a"), end.alias("b")))), lambda s, i: F.struct(
        F.coalesce(F.get("cut", i - 1).b, F.lit(0)).alias("a"), s.a.alias("b")))
    pieces = F.transform(rest, lambda s: F.expr("body").substr(s.a + 1, s.b - s.a).cast("string"))
    kept = F.when(F.col("cut").isNull(), F.col("body")).otherwise(F.array_join(pieces, "").cast("binary"))
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), "body", F.coalesce("cut", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("cut"), kept.alias("kept"))


def report(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = dedup(docs.select("doc_id", "text"), width, keep=["doc_id"])
    n = F.octet_length("body").cast("bigint")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("cut").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
