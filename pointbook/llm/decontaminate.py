"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, matched in every document.

Words are runs of digits, lower-cased Latin letters and characters beyond
ASCII. An item's n-grams are its windows of ``width`` consecutive words; an
item with fewer words is one window. Documents are scanned for windows whose
hash is in the set, and each hit is verified word by word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, list_array, map_texts, written

# Benchmark text that one broadcast may hold; a larger benchmark is matched
# in several passes over the documents, each with a part of this size.
BROADCAST_BYTES = 32 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers


class Words:
    """The words of a run of texts: byte ranges, text of each, and hashes."""

    def __init__(self, texts: Texts):
        low = _LOWER[texts.data]
        inside = _IN_WORD[low]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, stop = edge == 1, edge == -1
        # a word also ends where its text does
        cut = texts.off[1:-1]
        cut = cut[(cut > 0) & (cut < len(low))]
        cut = cut[inside[cut] & inside[cut - 1]]
        start[cut] = stop[cut] = True
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(stop)
        self.low = low.tobytes()
        self.ends = np.searchsorted(self.start, texts.off)  # words before each text's end
        size = self.end - self.start
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
        place = np.arange(int(size.sum())) - (np.cumsum(size) - size).repeat(size)
        h = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(size) - size)
        self.hash = mix(h)

    def joined(self, i: int, n: int) -> bytes:
        return b" ".join([self.low[a:b] for a, b in zip(self.start[i:i + n].tolist(), self.end[i:i + n].tolist())])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def window_hashes(words: Words, widths: list[int]):
    """(width, hash of the window that starts at each word), by growing width."""
    with np.errstate(over="ignore"):
        acc = words.hash
        for n in range(1, max(widths, default=0) + 1):
            if n > 1:
                acc = acc[:-1] * _BASE + words.hash[n - 1:] if len(acc) > 1 else acc[:0]
            if n in widths:
                yield n, mix(acc)


class NGrams:
    """The n-grams of benchmark items: hashes to look up and words to verify."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.items: dict[bytes, set[int]] = defaultdict(set)
        words = Words(texts_from([t or "" for _, t in items]))
        spans = defaultdict(list)
        for k, (a, b) in enumerate(zip(words.ends.tolist(), words.ends[1:].tolist())):
            n = min(width, b - a)
            for i in range(a, b - n + 1) if n else ():
                self.items[words.joined(i, n)].update([] if items[k][0] is None else [items[k][0]])
                spans[n].append(i)
        self.hashes = {n: np.unique(h[np.array(spans[n])]) for n, h in window_hashes(words, sorted(spans))}
        # one bit of a small table for the top bits of each hash settles nearly all look-ups
        self.bits = {n: max(10, int(np.ceil(np.log2(len(h) * 16)))) for n, h in self.hashes.items()}
        self.flags = {}
        for n, h in self.hashes.items():
            self.flags[n] = np.zeros(1 << self.bits[n], bool)
            self.flags[n][h >> np.uint64(64 - self.bits[n])] = True

    def match(self, texts: Texts):
        """(words, hit flag of each word, items found by text)."""
        words = Words(texts)
        hit, found = np.zeros(len(words.start) + 1, np.int32), defaultdict(set)
        row = np.searchsorted(words.ends, np.arange(len(words.start)), side="right") - 1
        for n, h in window_hashes(words, sorted(self.hashes)):
            at = np.flatnonzero(self.flags[n][h >> np.uint64(64 - self.bits[n])])
            at = at[row[at] == row[at + n - 1]]
            k = np.minimum(np.searchsorted(self.hashes[n], h[at]), len(self.hashes[n]) - 1)
            for i in at[self.hashes[n][k] == h[at]].tolist():
                if (got := self.items.get(words.joined(i, n))) is not None:  # empty: an item without id
                    found[int(row[i])] |= got
                    hit[i] += 1
                    hit[i + n] -= 1
        return words, np.cumsum(hit[:-1]) > 0, found


def texts_from(rows: list[str]) -> Texts:
    raw = [r.encode("utf-8", "surrogatepass") for r in rows]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64))


def _scan(docs: DataFrame, items: list[tuple[int, str]], text: str, width: int, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work():
        grams = NGrams(shared.value, width)

        def run(texts: Texts) -> dict[str, pa.Array]:
            words, hit, found = grams.match(texts)
            at = np.flatnonzero(hit)
            ends = np.searchsorted(at, words.ends)
            # code points before each byte, for spans in code points of the text
            point = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            base = point[texts.off[:-1]].repeat(np.diff(ends))
            index = at - words.ends[:-1].repeat(np.diff(ends))
            hits = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (index, point[words.start[at]] - base, point[words.end[at]] - base)], ["word", "start", "end"])
            each = [sorted(found[k]) if k in found else [] for k in range(len(texts))]
            return {"n_words": pa.array(np.diff(words.ends)), "hits": list_array(hits, ends), "items": pa.array(each, pa.list_(pa.int64()))}
        return run

    return map_texts(docs, text, work, "n_words bigint, hits array<struct<word:int,start:int,end:int>>, items array<bigint>", keep)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", keep: list[str] | None = None,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``n_words``, ``hits`` (each hit word: its number, and its code points from start to end) and ``items`` (ids found).

    ``benchmark`` has item_id and text; items with null ids give hits but no
    id, those without words match nothing, and rows with the same id count as one
    item. Its size is measured first: up to ``broadcast_bytes`` of text it is
    one broadcast and one narrow pass; beyond, parts of that size are matched
    one after the other, each pass written, with the same result. Documents
    are never shuffled.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits", "items")]
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // broadcast_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    held = [tuple(r) for r in items.where(part == 0).collect()]
    if parts == 1:
        return _scan(docs, held, text, width, keep)
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"))
    for k in range(parts):
        if k:
            held = [tuple(r) for r in items.where(part == k).collect()]
            out = out.withColumnsRenamed({"hits": "hits_before", "items": "items_before"})
        out = _scan(out, held, "text", width, None)
        if k:
            out = (out.withColumn("hits", F.array_sort(F.array_union("hits_before", "hits")))
                   .withColumn("items", F.array_sort(F.array_union("items_before", "items"))).drop("hits_before", "items_before"))
        out = written(out, "decontaminate")
    return out.select("row.*", "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. A null text has no words."""
    found = scan(docs.select("doc_id", "text"), benchmark, width, keep=["doc_id"])
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    n = F.size("hits").cast("bigint")
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, mode: str = "documents") -> DataFrame:
    """The documents without benchmark text, in their own columns.

    ``mode`` "documents" drops each document with a hit; "spans" keeps it and
    cuts each run of hit words out of its text, from the first word's start to
    the last word's end. Documents without hits stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = scan(packed, benchmark, width, keep=["row"])
    if mode == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    first = F.filter("hits", lambda x, i: ~F.coalesce(F.get("hits", i - 1).word == x.word - 1, F.lit(False)))
    last = F.filter("hits", lambda x, i: ~F.coalesce(F.get("hits", i + 1).word == x.word + 1, F.lit(False)))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.start.alias("start"), b.end.alias("end")))
    text = F.col("row").getField("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = F.aggregate("spans", start, lambda acc, s: F.struct(
        F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at)).alias("out"), s.end.alias("at")),
        lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return (found.withColumn("spans", spans).withColumn("cleaned", F.when(F.size("hits") == 0, text).otherwise(rest))
            .select(*(F.col("cleaned").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns)))
