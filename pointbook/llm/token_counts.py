"""Exact token counts at every prefix of a text, by dynamic programming.

For a vocabulary of merges with word ends (a ``tokenizers`` BPE file). A
sequence of tokens is what the merges give exactly if each two neighbours are
what the merges give for those two alone. So the encoding of a word's prefix
ends in the one token that fits the last token of the encoding before it, and
the count there is one more. Each distinct word is solved once, for all its
prefixes; counts of the text add up over its words. The table at every prefix
then answers how many tokens a cut text has, and where to cut for a budget,
without encoding again.

Prefixes are those of the normalised text (NFC, each white-space run one
space, lower case), in code points: entry ``p`` of ``prefix_counts`` is the
count of its first ``p`` code points.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, list_array, map_texts

# Those of the splitting pattern with two letters, a fixed value.
LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))

# Capitals of Unicode 16 that this Python may not know yet, and their lower case; fixed values.
NEWER_LOWER = {0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0x1C89: 0x1C8A} | {0x10D50 + i: 0x10D70 + i for i in range(22)}

NEWER = re.compile(f"[{''.join(map(chr, NEWER_LOWER))}]")

# Any character but printable ASCII, usual white space and Latin letters up to U+024F; and numbers there that are no digits.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-\u024f]|[²³¹¼½¾]")

TAIL_MARKS = regex.compile(r"[^\s\p{L}\p{N}]*$")

# What is known of a run of symbols: the end of a token only; in the
# vocabulary, not yet tried; a token that the merges give for its own symbols.
NO_TOKEN, UNTRIED, TOKEN = range(3)

# Words whose totals a worker remembers.
CACHE_TOTALS = 1_500_000

# Text that one pass holds at a time: the more words are solved together, the more they share.
PASS_BYTES = 4 << 20

# Words that a worker keeps in each of two generations (only speed depends on it).
CACHE_WORDS = 200_000


@functools.cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next of U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordCounter:
    """Counts by prefix for the words of one vocabulary."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        # ends of tokens: a run of symbols that is none cannot be part of a longer last token
        stems = [(t.removesuffix(self.end), self.end) if t.endswith(self.end) and t != self.end else (t, "") for t in self.vocab]
        self.tails = dict.fromkeys((stem[k:] + end for stem, end in stems for k in range(len(stem))), NO_TOKEN)
        self.tails.update(dict.fromkeys(self.vocab, UNTRIED))
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        # the same for texts of usual Latin characters, where the standard library's classes agree, and it is faster
        latin = self.words.pattern
        for own, same in (("[^\\s\\p{L}\\p{N}]", "(?:[^\\s\\w]|_)"), ("[\\p{L}]", "[^\\W\\d_]"), ("[\\p{N}]", "\\d")):
            latin = latin.replace(own, same)
        self.latin_words = self.words if "\\p{" in latin else re.compile(latin)
        self.special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, np.ndarray] = {}
        self.older: dict[str, np.ndarray] = {}
        self.whole: dict[str, int] = {}

    def parts(self, token: str) -> list[str]:
        """The single symbols of a token."""
        stem = token.removesuffix(self.end) if len(token) > len(self.end) else token
        out = list(stem)
        if stem is not token and stem != token:
            out[-1] += self.end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """The merges applied by rank, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 40) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 40:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, last: str, token: str) -> bool:
        """Whether the merges leave these two tokens side by side."""
        if len(self.fits) > CACHE_TOTALS:
            self.fits.clear()
        got = self.fits[last, token] = self.merge(self.parts(last) + self.parts(token)) == [last, token]
        return got

    def solve(self, words: list[str]) -> dict[str, np.ndarray]:
        """For each word the counts of its prefixes of 1, 2, ... code points, each as a whole word.

        All that is kept at a prefix depends on that prefix alone, so in
        sorted order each word goes on from what it shares with the one before.
        """
        solved: dict[str, np.ndarray] = {}
        whole = [0]
        for raw, word, text, same, last, count in self.prefixes(words):
            n = len(raw)
            del whole[same + 1:]
            for p in range(same + 1, n + 1):
                cut = p < n and raw[p] & 0xC0 == 0x80  # inside a code point
                whole.append(0 if cut else count[self.closing(text, p, self.end, last)[0]] + 1)
            row = np.array(whole[1:n + 1], np.int32)
            solved[word] = row if len(word) == n else row[row > 0]
        return solved

    def solve_whole(self, words: list[str]) -> dict[str, int]:
        """For each word its count as a whole: the same table at all prefixes, closed at the word's end only."""
        return {word: count[self.closing(text, len(raw), self.end, last)[0]] + 1 for raw, word, text, _, last, count in self.prefixes(words)}

    def prefixes(self, words: list[str]):
        """(bytes, word, symbols, shared bytes, last token, count) of each word in sorted order; the last two at every prefix of its symbols."""
        table = dict(enumerate(byte_symbols()))
        last, count, before = [""], [0], b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            text = raw.decode("latin-1").translate(table)
            same = 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                same += 1
            del last[same + 1:], count[same + 1:]
            for p in range(same + 1, len(raw) + 1):
                q, token = self.closing(text, p, "", last)
                last.append(token)
                count.append(count[q] + 1)
            yield raw, word, text, same, last, count
            before = raw

    def closing(self, text: str, p: int, end: str, last: list[str]) -> tuple[int, str]:
        """Where the last token of the first ``p`` symbols starts, and the token: the one that fits what comes before it."""
        tails, fits = self.tails, self.fits
        for q in range(p - 1, -1, -1):
            token = text[q:p] + end
            state = tails.get(token)
            if state is None:
                break
            if state is UNTRIED:
                state = tails[token] = TOKEN if self.merge(self.parts(token)) == [token] else NO_TOKEN
            if state is TOKEN:
                if not q:
                    return 0, token
                fit = fits.get((last[q], token))
                if self.follows(last[q], token) if fit is None else fit:
                    return q, token
        raise ValueError("the vocabulary lacks a single symbol")

    def learn(self, words: set[str]) -> None:
        """Solve those of the words that are not known yet."""
        if len(self.known) >= CACHE_WORDS:
            self.older, self.known = self.known, {}
        older, known, new = self.older, self.known, []
        for w in words.difference(known):
            got = older.get(w)
            if got is None:
                new.append(w)
            else:
                known[w] = got
        known.update(self.solve(new))

    @staticmethod
    def lowered(text: str) -> str:
        """NFC, in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma is no special case
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return low.translate(NEWER_LOWER) if NEWER.search(low) else low

    @classmethod
    def normal(cls, text: str) -> str:
        return regex.sub(r"\s+", " ", cls.lowered(text))

    def split_words(self, text: str) -> list[str]:
        """The words of a text; white space, which is no part of any, need not be normalised."""
        low = self.lowered(text)
        return (self.words if UNUSUAL.search(text) else self.latin_words).findall(low)

    def segment(self, text: str, words: list[str]) -> np.ndarray:
        """Counts at the prefixes of 1, 2, ... code points of a normalised text without special tokens; ``words`` are its learnt words."""
        if not words:
            return np.zeros(len(text), np.int32)
        each = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, each), np.int64, len(each))
        counts = np.concatenate(each)
        ends = np.cumsum(size)
        full = counts[ends - 1]
        counts = counts + (np.cumsum(full, dtype=np.int32) - full).repeat(size)
        # a contraction cut short is two words: the quote, then a letter (one token each)
        for k in [k for k, w in enumerate(words) if w in LONG_CONTRACTIONS]:
            at = int(ends[k]) - 3
            counts[at + 1] = counts[at] + 1
        if len(counts) == len(text):
            return counts
        out = np.zeros(len(text), np.int32)
        inside = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != 0x20
        out[inside] = counts
        blank = np.flatnonzero(~inside)
        before = np.cumsum(inside)[blank]
        out[blank] = np.where(before > 0, counts[before - 1], 0)
        return out

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """A text as normalised segments, each with the special token that ends it ("" at the end)."""
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out.append((self.normal(text[at:m.start()]), m[0]))
            at = m.end()
        return [*out, (self.normal(text[at:]), "")]

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts at every prefix of its normalised form, from the empty one on."""
        # each segment; and, for the prefixes that cut a special token, that token behind the run of
        # marks which the cut one would go on from
        jobs, need = [], set()
        for text in texts:
            row = []
            for seg, special in self.pieces(text):
                words = self.words.findall(seg)
                tail = TAIL_MARKS.search(seg)[0] + special if special else ""
                tail_words = self.words.findall(tail)
                need.update(words, tail_words)
                row.append((seg, words, special, tail, tail_words))
            jobs.append(row)
        self.learn(need)
        out = []
        for row in jobs:
            parts, base = [np.zeros(1, np.int32)], 0
            for seg, words, special, tail, tail_words in row:
                got = self.segment(seg, words)
                here = base + (int(got[-1]) if len(got) else 0)
                parts.append(got + np.int32(base))
                if special:
                    marks = len(tail) - len(special)
                    ahead = base + (int(got[len(seg) - marks - 1]) if len(seg) > marks else 0)
                    cut = self.segment(tail, tail_words)[marks:] + np.int32(ahead)
                    cut[-1] = base = here + 1
                    parts.append(cut)
            out.append(np.concatenate(parts))
        return out


    def totals(self, texts: list[str]) -> list[int]:
        """The count of each whole text."""
        jobs = []
        for text in texts:
            parts, n = [text], 0
            if any(s in text for s in self.special):
                parts = self.split.split(text)
                n = len(parts) - 1
            jobs.append(([w for part in parts for w in self.split_words(part)], n))
        need = set().union(*(words for words, _ in jobs))
        if len(self.whole) > CACHE_TOTALS:
            self.whole = {}
        self.whole.update(self.solve_whole(list(need - self.whole.keys())))
        got = self.whole.__getitem__
        return [sum(map(got, words)) + n for words, n in jobs]


_counters: dict[str, WordCounter] = {}


def counter_of(content: str) -> WordCounter:
    """This worker process's counter for the vocabulary, with the words that earlier tasks have solved."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = WordCounter(content)
    return _counters[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 2 MB


def prefix_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``prefix_counts`` (array<int>): the exact token count of every prefix of the text.

    The empty or null text has the one entry 0. Special strings inside a text
    count as one token where they are whole, and as ordinary text where the
    prefix cuts them. No shuffle; repeated rows are counted each.
    """
    shared = _vocabulary(df, path)

    def work():
        counter = counter_of(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            rows = counter.counts([t.decode("utf-8", "surrogatepass") for t in texts.each()])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            return {"prefix_counts": list_array(np.concatenate(rows) if rows else np.zeros(0, np.int32), ends)}
        return run

    return map_texts(df, text, work, "prefix_counts array<int>", keep, PASS_BYTES)


def totals(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` (bigint): the last entry of ``prefix_counts``, without the entries before it. A null or empty text has 0."""
    shared = _vocabulary(df, path)

    def work():
        counter = counter_of(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            return {"n_tokens": pa.array(counter.totals([t.decode("utf-8", "surrogatepass") for t in texts.each()]), pa.int64())}
        return run

    return map_texts(df, text, work, "n_tokens bigint", keep, PASS_BYTES)


def total(counts: Column) -> Column:
    """The count of the whole text."""
    return F.element_at(counts, -1).cast("bigint")


def cut_within(counts: Column, budget: int) -> Column:
    """The most code points of the normalised text that take at most ``budget`` tokens."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
