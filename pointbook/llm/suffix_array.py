"""External suffix sorting by induction, with common-prefix values.

Suffixes are sorted by inducing: from the sorted suffixes at left-most
S-positions (S*) those of type L follow in ascending order, and from these
the ones of type S in descending order. The S* suffixes themselves are sorted
by inducing their pieces, naming equal pieces alike, and recursing on the
string of names (a short one is sorted in memory by doubling). Both inductions are one loop over a priority queue: items
leave by (symbol, type), equal ones in order of arrival, and each puts the
suffix one to its left back into the queue. The queue takes out, as one
array, all items up to the first that a put-back one must precede; what waits
further on lies in buckets, on disk once more than a given number wait.

Items carry the length of the prefix that they share with the item before
them. For two neighbours put back under the same symbol it is one more than
the least such value between their sources. Values stop at ``cap``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

# Items that wait in memory before buckets go to disk, bytes of an array that
# stays in memory, and items handled at a time.
WAITING = 4_000_000
HELD_BYTES = 256 << 20
BATCH = 1 << 16

# A string of names no longer than this is not recursed on but sorted in memory.
BASE_NAMES = 3 << 20


class Store:
    """A temporary folder for arrays that are too large for memory; removed at the end."""

    def __init__(self, waiting: int = WAITING, held: int = HELD_BYTES, base: int = BASE_NAMES):
        self.waiting, self.held, self.base, self.folder, self.n = waiting, held, base, None, 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            self.folder.cleanup()

    def path(self) -> str:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        self.n += 1
        return os.path.join(self.folder.name, str(self.n))

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.held:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))


# An item is one integer: its key, its position and its value.
LCP_BITS = 8


class Form:
    """How items of a text of ``n`` symbols are packed."""

    def __init__(self, n: int, keys: int):
        self.low = max(1, n.bit_length()) + LCP_BITS
        if self.low + keys.bit_length() > 63:
            raise ValueError("the text is too long")

    def pack(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
        return key << self.low | at << LCP_BITS | lcp

    def key(self, rows: np.ndarray) -> np.ndarray:
        return rows >> self.low

    def at(self, rows: np.ndarray) -> np.ndarray:
        return (rows & ((1 << self.low) - 1)) >> LCP_BITS

    @staticmethod
    def lcp(rows: np.ndarray) -> np.ndarray:
        return (rows & 255).astype(np.uint8)


class Queue:
    """A priority queue of items by key, first come first served among equals, in buckets of adjacent keys.

    The keys of a text of bytes have a bucket each, which needs no sorting.
    """

    def __init__(self, store: Store, form: Form, keys: int, buckets: int = 1024):
        self.store, self.form, self.width = store, form, -(-keys // buckets)
        self.parts: list[list[np.ndarray]] = [[] for _ in range(buckets + 1)]
        self.files: dict[int, str] = {}
        self.n = 0

    def put(self, rows: np.ndarray) -> None:
        """Add items whose order is that of arrival."""
        if not len(rows):
            return
        bucket = (self.form.key(rows) // self.width).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(rows)]
        for i, j in zip(cut, cut[1:]):
            self.parts[bucket[i]].append(rows[i:j])
        self.n += len(rows)
        if self.n > self.store.waiting:
            self.spill()

    def spill(self) -> None:
        for b, parts in enumerate(self.parts):
            if parts:
                path = self.files.setdefault(b, self.store.path())
                with open(path, "ab") as f:
                    for p in parts:
                        p.tofile(f)
                parts.clear()
        self.n = 0

    def take(self, b: int) -> np.ndarray:
        """All items of a bucket, sorted."""
        rows = []
        if b in self.files:
            path = self.files.pop(b)
            rows.append(np.fromfile(path, np.int64))
            os.remove(path)
        rows += self.parts[b]
        if not rows:
            return np.zeros(0, np.int64)
        self.n -= sum(map(len, self.parts[b]))
        self.parts[b] = []
        out = np.concatenate(rows)
        return self.sorted(out)

    def sorted(self, rows: np.ndarray) -> np.ndarray:
        return rows if self.width == 1 else rows[np.argsort(self.form.key(rows), kind="stable")]

    def drain(self, step: Step) -> Iterator[np.ndarray]:
        """Items in order, by batches; ``step`` gives the items that a batch puts back (of its own keys or later ones)."""
        key = self.form.key
        for b in range(len(self.parts)):
            top = (b + 1) * self.width
            while len(now := self.take(b)):
                while len(now):
                    batch = step.settle(now[:BATCH])
                    back = step.back(batch)
                    inner = key(back) < top
                    stop = len(batch)
                    if inner.any() and self.width > 1:
                        # a put-back item precedes what has a larger key: stop before the first such
                        stop = int(np.searchsorted(key(batch), key(back[inner]).min(), side="right"))
                        if stop < len(batch):
                            batch, back = batch[:stop], step.cut(back, stop)
                            inner = inner[:len(back)]
                    step.done(batch)
                    yield batch
                    self.put(back[~inner])
                    rest, again = now[stop:], back[inner]
                    if not len(rest):
                        now = self.sorted(again)
                    elif len(again) and self.width == 1:
                        now = np.concatenate([rest, again])
                    elif len(again):
                        again = self.sorted(again)
                        now = np.insert(rest, np.searchsorted(key(rest), key(again), side="right"), again)
                    else:
                        now = rest


def types_of(text: np.ndarray, store: Store) -> np.ndarray:
    """True for suffixes of type S: smaller than the one that starts next. The end counts as the least symbol."""
    n = len(text)
    out = store.array(n, bool)
    later = False  # of the last position: the end is smaller, so it is L
    for b in range(n, 0, -(BATCH * 16)):
        a = max(0, b - BATCH * 16)
        here = text[a:b].astype(np.int64)
        after = np.append(here[1:], int(text[b]) if b < n else -1)
        sign = np.sign(after - here)
        known = np.flatnonzero(sign)
        value = np.append(sign[known] > 0, later)
        out[a:b] = value.repeat(np.diff(np.concatenate([[-1], known, [b - a - 1]])))  # each up to the next known one
        later = bool(out[a])
    return out


class Step:
    """What a batch puts back: the suffix to the left of each item, if it is of the wanted type."""

    def __init__(self, codes: np.ndarray, want: bool, top: int, form: Form, cap: int, words: np.ndarray | None):
        """``codes``: at each position twice the symbol, and one more for type S."""
        self.codes, self.want, self.top, self.form, self.cap = codes, want, top, form, cap
        # per key, the least value seen since an item was last put under it
        self.since = np.zeros(2 * top + 2, np.uint8)
        self.known = np.zeros(2 * top + 2, bool)
        self.last, self.words = (-1, -1), words

    def settle(self, batch: np.ndarray) -> np.ndarray:
        """The value of each key's first item set against the item that leaves just before it."""
        if not self.cap:
            return batch
        key, at = np.append(self.last[0], self.form.key(batch)), np.append(self.last[1], self.form.at(batch))
        new = np.flatnonzero(key[1:] != key[:-1])
        if len(new):
            value = np.zeros(len(new), np.int64)
            same = (key[new] >> 1 == key[new + 1] >> 1) & (key[new] >= 0)
            value[same] = shared_prefix(self.words, at[new][same], at[new + 1][same], self.cap)
            batch = batch.copy()
            batch[new] = (batch[new] & ~255) | value
        return batch

    def left(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which items put one back, its position, its key)"""
        at = self.form.at(batch) - 1
        code = self.codes[at]
        use = np.flatnonzero((at >= 0) & (code & 1 == self.want))
        code = code[use].astype(np.int64)
        return use, at[use], 2 * self.top + 1 - code if self.want else code

    def back(self, batch: np.ndarray) -> np.ndarray:
        use, at, key = self.seen = self.left(batch)
        return self.form.pack(key, at, self._shared(self.form.lcp(batch), use, key) if self.cap else 0)

    def cut(self, back: np.ndarray, stop: int) -> np.ndarray:
        """Of what a batch puts back, that of its first ``stop`` items: it depends on none of the later ones."""
        k = int(np.searchsorted(self.seen[0], stop))
        self.seen = tuple(x[:k] for x in self.seen)
        return back[:k]

    def _shared(self, lcp: np.ndarray, use: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(use):
            return np.zeros(0, np.int64)
        order = np.argsort(key.astype(np.uint16) if 2 * self.top < 1 << 16 else key, kind="stable")
        k, i = key[order], use[order]
        first = np.append(True, k[1:] != k[:-1])
        least = least_between(lcp, np.append(0, i[:-1] + 1), i, ~first)
        heads = np.flatnonzero(first)
        ahead = np.minimum.accumulate(lcp)
        least[heads] = np.minimum(ahead[i[heads]], self.since[k[heads]])
        value = np.minimum(least.astype(np.int64) + 1, self.cap)
        value[heads[~self.known[k[heads]]]] = 0  # nothing before it under this key
        out = np.empty(len(use), np.int64)
        out[order] = value
        return out

    def done(self, batch: np.ndarray) -> None:
        """Remember, of a batch that has left the queue, the least values since each key's last item."""
        if not self.cap:
            return
        lcp = self.form.lcp(batch)
        use, _, key = self.seen
        np.minimum(self.since, lcp.min(), out=self.since)
        if len(use):
            behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.since[key] = behind[use + 1]  # the last of equal keys stands
            self.known[key] = True
        self.last = int(self.form.key(batch[-1:])[0]), int(self.form.at(batch[-1:])[0])


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The least of ``values[a..b]`` (inclusive) where asked, from a table of spans of powers of two."""
    out = np.zeros(len(a), np.uint8)
    at = np.flatnonzero(where)
    if not len(at):
        return out
    a, b = a[at], b[at]
    level = np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1
    n = len(values)
    table = np.zeros((int(level.max()) + 1, n), np.uint8)
    table[0] = values
    for j in range(1, len(table)):
        half = 1 << j - 1
        np.minimum(table[j - 1, :-half], table[j - 1, half:], out=table[j, :-half])
    row = level * n
    table = table.reshape(-1)
    out[at] = np.minimum(table[row + a], table[row + b + 1 - (1 << level)])
    return out


WORD = 7  # symbols below 512 that one integer holds


def codes_of(text: np.ndarray, types: np.ndarray, top: int, store: Store) -> np.ndarray:
    """At each position twice the symbol, and one more for type S."""
    out = store.array(len(text), np.uint16 if 2 * top + 1 < 1 << 16 else np.int64)
    for a in range(0, len(text), 1 << 20):
        b = a + (1 << 20)
        out[a:b] = text[a:b].astype(np.int64) << 1 | types[a:b]
    return out


def packed_words(text: np.ndarray, store: Store) -> np.ndarray:
    """At each position the next WORD symbols (below 512; zeros after the end) in one integer."""
    out = store.array(len(text), np.int64)
    for a in range(0, len(text), 1 << 20):
        b = min(len(text), a + (1 << 20))
        part = np.zeros(b - a + WORD, np.int64)
        here = text[a:b + WORD]
        part[:len(here)] = here
        word = part[:b - a].copy()
        for k in range(1, WORD):
            word = word << 9 | part[k:b - a + k]
        out[a:b] = word
    return out


def shared_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The length of the common prefix of suffixes a and b of the packed text, up to ``cap``."""
    out = np.zeros(len(a), np.int64)
    live, last = np.arange(len(a)), len(words) - 1
    for k in range(0, cap, WORD):
        x, y = np.minimum(a[live] + k, last), np.minimum(b[live] + k, last)
        differ = words[x] ^ words[y]
        same = differ == 0
        stop = live[~same]
        rest = differ[~same]
        more = np.zeros(len(stop), np.int64)
        for j in range(1, WORD):
            more += rest >> 9 * (WORD - j) == 0
        out[stop] = k + more
        live = live[same]
        out[live] = k + WORD
        if not len(live):
            break
    left = len(words) - np.maximum(a, b)
    return np.minimum(np.minimum(out, cap), left).astype(np.uint8)


def _passes(text: np.ndarray, types: np.ndarray, stars: np.ndarray, store: Store, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, from S* suffixes in ascending order; with prefix values if ``cap``."""
    top, n = int(text.max()), len(text)
    form = Form(n, 2 * top + 1)
    words, codes = packed_words(text, store) if cap else None, codes_of(text, types, top, store)
    up = Queue(store, form, 2 * top + 2)
    # the end of the text, the least suffix, comes first and puts back the last position
    up.put(form.pack(np.array([2 * int(text[n - 1])]), np.array([n - 1]), 0))
    for i in range(0, len(stars), BATCH):
        at = np.asarray(stars[i:i + BATCH])
        lcp = shared_prefix(words, np.append(stars[i - 1] if i else at[0], at[:-1]), at, cap).astype(np.int64) if cap else 0
        up.put(form.pack(2 * text[at].astype(np.int64) + 1, at, lcp))
    grown = Step(codes, False, top, form, cap, words)
    grown.known[2 * int(text[n - 1])] = True
    path, total = store.path(), 0
    with open(path, "wb") as f:
        for batch in up.drain(grown):
            rows = batch[form.key(batch) % 2 == 0]
            rows.tofile(f)
            total += len(rows)
    down = Queue(store, form, 2 * top + 2)
    back = np.memmap(path, np.int64, "r", shape=(total,))
    follower = 0  # the value between a suffix and the next larger one
    for b in range(total, 0, -BATCH):
        rows = np.array(back[max(0, b - BATCH):b])[::-1]
        lcp = np.append(follower, rows[:-1] & 255)
        follower = int(rows[-1]) & 255
        down.put(form.pack(2 * (top - form.key(rows) // 2) + 1, form.at(rows), lcp))
    del back
    os.remove(path)
    for batch in down.drain(Step(codes, True, top, form, cap, words)):
        yield form.at(batch), form.lcp(batch)


def _star_positions(types: np.ndarray) -> np.ndarray:
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _sorted_stars(text: np.ndarray, types: np.ndarray, store: Store, depth: int) -> np.ndarray:
    """S* suffixes in ascending order: their pieces by induction, then their names' suffixes by recursion."""
    stars = _star_positions(types)
    if len(stars) < 2:
        return stars
    is_star = store.array(len(text), bool)
    is_star[stars] = True
    by_piece = store.array(len(stars), np.int64)
    k = len(stars)
    for at, _ in _passes(text, types, stars, store, 0):
        at = at[is_star[at]]
        by_piece[k - len(at):k] = at[::-1]
        k -= len(at)
    # a piece reaches to the next star's position; equal pieces get one name
    index = store.array(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
    index[stars] = np.arange(len(stars))
    length = np.append(np.diff(stars), len(text) - stars[-1]) + 1
    new = np.ones(len(stars), bool)
    for i in range(1, len(stars), BATCH):
        both = np.asarray(by_piece[i - 1:i + BATCH])
        a, b = both[:-1], both[1:]
        size = length[index[both]]
        like = np.flatnonzero((size[:-1] == size[1:]) & (a != stars[-1]) & (b != stars[-1]))
        if not len(like):
            continue
        size = size[1:][like]
        step = np.arange(int(size.sum())) - (np.cumsum(size) - size).repeat(size)
        equal = text[a[like].repeat(size) + step] == text[b[like].repeat(size) + step]
        new[i + like[np.logical_and.reduceat(equal, np.cumsum(size) - size)]] = False
    name = np.cumsum(new) - 1
    if int(name[-1]) + 1 == len(stars):
        return by_piece
    reduced = store.array(len(stars), np.int64)
    reduced[index[by_piece]] = name
    del by_piece, index, is_star, new, name, length
    if len(stars) <= store.base:
        return stars[by_doubling(reduced, -(-depth // 2))]  # a piece has two symbols at least
    order = store.array(len(stars), np.int64)
    k = len(stars)
    for at, _ in _descending(reduced, store, 0):
        order[k - len(at):k] = at[::-1]
        k -= len(at)
    return stars[order]


def by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a short string of names, by at least their first ``depth`` names (0: in full).

    Names that occur once are in place; the others are told apart by what
    comes 1, 2, 4, ... names later.
    """
    n = len(names)
    count = np.bincount(names)
    rank = np.append((np.cumsum(count) - count)[names], -1)  # of the first in a group of equals; the end is the least
    live, h = np.flatnonzero(count[names] > 1), 1
    while len(live) and (not depth or h < depth):
        own = rank[live]
        pair = own * (n + 1) + rank[np.minimum(live + h, n)] + 1
        order = np.argsort(pair)
        live, pair, own = live[order], pair[order], own[order]
        at = np.arange(len(live))
        new = np.append(True, pair[1:] != pair[:-1])
        group = np.append(True, own[1:] != own[:-1])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[live] = own + start - np.maximum.accumulate(np.where(group, at, 0))
        live = live[~(new & np.append(new[1:], True))]
        h *= 2
    return np.argsort(rank[:n])


def _descending(text: np.ndarray, store: Store, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    types = types_of(text, store)
    yield from _passes(text, types, _sorted_stars(text, types, store, cap), store, cap)


def suffixes_descending(text: np.ndarray, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, shared prefix with the suffix before, up to ``cap`` of at most 254) of all suffixes of ``text`` (symbols below 512), from the largest down.

    Suffixes are in order by their first ``cap`` symbols at least.
    """
    if len(text):
        yield from _descending(text, store, cap)
