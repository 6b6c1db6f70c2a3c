"""Byte-level BPE encoding and decoding of document texts.

Pre-token boundaries come from the scans of :mod:`pretokens`; each distinct
slice is merged once and kept in a bounded cache of the worker. Ids and the
byte offset of every token are stored as packed little-endian unsigned 32-bit
integers, the usual form of token files.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Texts, binary_array, map_texts
from .pretokens import boundaries

# Distinct slices in each of a worker's two generations of cache (only speed depends on it).
CACHE_SLICES = 100_000

# From this many bytes on, pairs are kept in a queue; fixed, both ways give the same ids.
LONG_PIECE = 64
NO_PAIR = 1 << 40


class Ranks:
    """A rank file: token bytes and their ids, which are also the merge ranks."""

    def __init__(self, content: bytes):
        self.by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        tokens: list[bytes] = [b""] * (max(self.by_bytes.values()) + 1)
        for t, i in self.by_bytes.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
        rank = self.by_bytes
        if piece in rank:
            return [rank[piece]]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [rank.get(piece[i:i + 2], NO_PAIR) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NO_PAIR:
                break
            i = pairs.index(best)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank.get(joined + parts[i + 1], NO_PAIR)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + joined, NO_PAIR)
        return [rank[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a queue of pairs, so that a very long slice takes n log n steps."""
        rank = self.by_bytes
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rank[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in rank]
        heapq.heapify(queue)
        gone = bytearray(n + 1)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue  # a part of this pair has been joined meanwhile
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank.get(piece[a:end[b]])) is not None:
                    heapq.heappush(queue, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i:end[i]]])
            i = after[i]
        return out


class Encoder(dict):
    """Packed ids by slice; a slice that is not there yet is merged."""

    def __init__(self, content: bytes):
        self.ranks = Ranks(content)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        got = self.older.get(piece)
        if got is None:
            ids = self.ranks.merge(piece)
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_SLICES:
            self.older = dict(self)
            self.clear()
        self[piece] = got
        return got

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each within its text, 0 and the end of each text in tokens)."""
        starts = boundaries(texts)
        raw = texts.raw()
        at = [*starts.tolist(), len(raw)]
        packed = b"".join([self[raw[a:b]] for a, b in zip(at, at[1:])])
        ids = np.frombuffer(packed, "<u4")
        where = np.concatenate([[0], np.cumsum(self.ranks.size[ids])])
        ends = np.searchsorted(where[:-1], texts.off, side="left")
        return ids, where[:-1] - texts.off[:-1].repeat(np.diff(ends)), ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, 0 and the end of each text in bytes): each token's bytes go to its retained offset."""
        size = self.ranks.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        text_ends = total[ends]
        to = offsets + text_ends[:-1].repeat(np.diff(ends))
        step = np.arange(total[-1]) - total[:-1].repeat(size)
        out = np.empty(total[-1], np.uint8)
        out[to.repeat(size) + step] = self.ranks.data[self.ranks.start[ids].repeat(size) + step]
        return out, text_ends


def _vocabulary(spark: SparkSession, path: str):
    """The rank file's bytes for the workers; a vocabulary is bounded, about 1 MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``offsets`` (binary): each token's id and byte offset in the text.

    An empty or null text has no tokens. No shuffle; repeated rows are encoded each.
    """
    shared = _vocabulary(df.sparkSession, ranks_path)

    def work():
        encoder = Encoder(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            ids, offsets, ends = encoder.encode(texts)
            return {"ids": binary_array(ids.view(np.uint8), ends * 4),
                    "offsets": binary_array(offsets.astype("<u4").view(np.uint8), ends * 4)}
        return run

    return map_texts(df, text, work, "ids binary, offsets binary", keep)


def recode(df: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``, ``offsets`` and ``decoded`` (binary): each text encoded, then decoded from its ids, in one pass.

    The same as ``decode(encode(df))`` with half the Python workers of a task.
    An empty or null text has no tokens and decodes to empty bytes.
    """
    shared = _vocabulary(df.sparkSession, ranks_path)

    def work():
        encoder = Encoder(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            ids, offsets, ends = encoder.encode(texts)
            data, stops = encoder.decode(ids, offsets, ends)
            return {"ids": binary_array(ids.view(np.uint8), ends * 4),
                    "offsets": binary_array(offsets.astype("<u4").view(np.uint8), ends * 4),
                    "decoded": binary_array(data, stops)}
        return run

    return map_texts(df, text, work, "ids binary, offsets binary, decoded binary", keep)


def decode(df: DataFrame, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary): the bytes that ``ids`` and ``offsets`` stand for (null ids: empty)."""
    from pyspark.sql import functions as F

    shared = _vocabulary(df.sparkSession, ranks_path)
    both = F.concat(F.coalesce(F.col("ids"), F.lit(b"")), F.coalesce(F.col("offsets"), F.lit(b"")))
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), both.alias("both"))

    def work():
        encoder = Encoder(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            values = texts.data.view("<u4")
            cut = texts.off // 4
            half = np.diff(cut) // 2
            ends = np.concatenate([[0], np.cumsum(half)])
            step = np.arange(ends[-1]) - ends[:-1].repeat(half)
            at = cut[:-1].repeat(half) + step
            data, stops = encoder.decode(values[at], values[at + half.repeat(half)].astype(np.int64), ends)
            return {"decoded": binary_array(data, stops)}
        return run

    return map_texts(packed, "both", work, "decoded binary", ["row"]).select("row.*", "decoded")
