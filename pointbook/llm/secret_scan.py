"""Secret scans: fixed forms of secrets, and values whose guess cost is high where a credential is expected.

The guess cost of a value is the least cost of any way to cut it into known
words, dates, repeats, keyboard walks and single characters to try by brute
force; costs are decimal logarithms of the guesses an attacker needs.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, map_texts

KINDS = ("assign", "access", "hex", "guess")

# The base forms, fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

# Where a credential's value is expected beside the base forms: an identifier (one word more may stand before it) and
# a sign, an Authorization header, or a URL's user part. The identifier holds one of the words below, long ones after
# any letters (dbpassword), short ones at a part of their own (DB_PIN, userAuth), each with more parts behind.
NAMED = re.compile(r"""(?<![A-Za-z0-9_.-])((?:[A-Za-z0-9_.-]++ )?[A-Za-z0-9_.-]++)["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?""", re.ASCII)
NAMES = re.compile(r"""(?:
    (?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|authorization|(?:api|access|private|client|secret|signing)[ _.-]?(?:key|secret|token))
    | (?:(?<![A-Za-z])(?i:pass|pin|auth|bearer) | (?<=[a-z])(?:Pass|Pin|PIN|Auth|Bearer))
    ) (?:[sS](?![A-Za-z]))? (?![a-z])(?: (?<![A-Z])|(?![A-Z]) )""", re.ASCII | re.VERBOSE)
VALUE = re.compile(r"""[^\s"'<>]+""")
CONTEXTS = (
    re.compile(r"""authorization["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?(?:bearer|basic|token)[ \t]+["']?([^\s"'<>]+)""", re.ASCII | re.IGNORECASE),
    re.compile(r"""\b[a-z][a-z0-9+.-]*://[^\s/:@"']+:([^\s/@"']+)@""", re.ASCII | re.IGNORECASE),
)
MIN_VALUE = 6

# From 10^MIN_LOG_GUESSES guesses on, a value counts as a secret and not as a placeholder.
MIN_LOG_GUESSES = 10.0

# Words that passwords and placeholders are made of, by falling frequency; fixed values.
COMMON_WORDS = (
    "password", "pass", "admin", "user", "root", "test", "example", "secret", "token", "key", "login", "welcome",
    "changeme", "change", "letmein", "default", "guest", "master", "dragon", "monkey", "shadow", "sunshine",
    "princess", "football", "baseball", "superman", "batman", "iloveyou", "love", "hello", "summer", "winter",
    "spring", "autumn", "secure", "security", "access", "system", "server", "service", "public", "private", "sample",
    "demo", "temp", "dummy", "placeholder", "insert", "your", "here", "enter", "value", "string", "none", "null",
    "true", "false", "undefined", "unknown", "redacted", "hidden", "removed", "the", "this", "that", "not", "set",
    "env", "config", "database", "mysql", "postgres", "oracle", "redis", "docker", "local", "localhost", "prod",
    "production", "staging", "dev", "developer", "development", "client", "account", "email", "mail", "name",
    "username", "phone", "data", "api", "auth", "bearer", "basic", "foo", "bar", "baz", "hunter", "killer", "trust",
    "ninja", "cheese", "computer", "internet", "freedom", "michael", "jordan", "thomas", "charlie", "daniel", "jessica",
)

# Rows of a keyboard and the alphabet, along which walks go; fixed values.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")

# Letters that other signs stand for; fixed values.
LEET = str.maketrans("@4301$5!7", "aaeoissit")

_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)", re.ASCII)
_REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)


def _signs(c: str) -> float:
    """Guesses for one character by brute force: those of its class."""
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


class GuessCost:
    """Guess costs over a ranked list of words."""

    def __init__(self, words: tuple[str, ...] = COMMON_WORDS):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
        self.most = max(map(len, self.rank), default=0)
        steps = {}
        for row in WALKS:
            for line in (row, row[::-1]):
                steps.update(((a, b), True) for a, b in zip(line, line[1:]))
        self.steps = steps

    def pieces(self, value: str):
        """(start, end, cost) of every word, date, repeat and walk in a value."""
        low = value.lower()
        plain = low.translate(LEET)
        n = len(value)
        if len(low) != n or len(plain) != n:  # a letter whose lower case is longer
            low = plain = value
        for i in range(n):
            for j in range(i + 3, min(n, i + self.most) + 1):
                for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                    if form in self.rank:
                        upper = sum(c.isupper() for c in value[i:j])
                        yield i, j, math.log10(self.rank[form] + 1) + extra + (math.log10(2) if upper in (1, j - i) else 0.3 * upper)
                        break
            if m := _DATE.match(value, i):
                yield i, m.end(), math.log10(120 if m.end() - i == 4 else 120 * 366) + (0.6 if m[1] or m[2] else 0.0)
        for m in _REPEAT.finditer(value):
            unit = m[1]
            yield m.start(), m.end(), sum(math.log10(_signs(c)) for c in unit) + math.log10(len(m[0]) // len(unit))
        i = 0
        while i < n:
            j = i + 1
            while j < n and (low[j - 1], low[j]) in self.steps:
                j += 1
            if j - i >= 3:
                for k in range(i, j - 2):  # any part of the walk
                    yield k, j, math.log10(len(WALKS) * 12 * (j - k))
                    yield i, j - (k - i), math.log10(len(WALKS) * 12 * (j - k))
            i = max(j - 1, i + 1) if j - i >= 3 else i + 1

    def __call__(self, value: str) -> float:
        """The least log10 of guesses over all cuts of the value into pieces and single characters."""
        ending: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in self.pieces(value):
            ending.setdefault(j, []).append((i, cost))
        best = [0.0]
        for j in range(1, len(value) + 1):
            least = best[j - 1] + math.log10(_signs(value[j - 1]))
            for i, cost in ending.get(j, ()):
                least = min(least, best[i] + cost)
            best.append(least)
        return best[-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms; every form's matches are leftmost and do not overlap."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def named_values(text: str):
    """(start, end) of the value behind each identifier that names a credential."""
    end = 0
    for m in NAMED.finditer(text):
        name = m[1]
        last = name.rfind(" ")
        if any(k.end() > last + 1 for k in NAMES.finditer(name)):
            if m.end() >= end:  # else it lies in the value before and ends with it
                value = VALUE.match(text, m.end())
                end = value.end() if value else m.end()
            yield m.end(), end


def guessed_spans(text: str, base: list[tuple[int, int, str]], cost: GuessCost, least: float) -> list[tuple[int, int, str]]:
    """Values in credential contexts that no base span covers wholly and whose guess cost is ``least`` or more."""
    if ":" not in text and "=" not in text:
        return []
    spans = {*named_values(text), *(m.span(1) for c in CONTEXTS for m in c.finditer(text))}
    out, end = [], 0
    for a, b in sorted(spans):
        if b - a >= MIN_VALUE and a >= end and not any(s <= a and b <= e for s, e, _ in base) and cost(text[a:b]) >= least:
            out.append((a, b, "guess"))
            end = b
    return out


def find(text: str, cost: GuessCost, least: float = MIN_LOG_GUESSES) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and then by kind."""
    base = base_spans(text)
    return sorted(base + guessed_spans(text, base, cost, least), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, text: str = "text", words: tuple[str, ...] = COMMON_WORDS, least: float = MIN_LOG_GUESSES,
         keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets``: array of (kind, start, end), in code points with the end exclusive, by start and kind.

    ``words`` is the ranked word list of the guess costs, ``least`` the log10
    of guesses from which a value is a secret. A null or empty text has none.
    One narrow pass; repeated rows are scanned each.
    """
    def work():
        cost = GuessCost(words)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def run(texts: Texts) -> dict[str, pa.Array]:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t.decode("utf-8", "surrogatepass"), cost, least)] for t in texts.each()]
            return {"secrets": pa.array(rows, pa.list_(kind))}
        return run

    return map_texts(docs, text, work, "secrets array<struct<kind:string,start:int,end:int>>", keep)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), keep=["doc_id"])
    number = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s.kind != "guess")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"), number("guess"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each run of secret spans replaced by ``mark``; texts without secrets stay as they are."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = scan(packed, keep=["row"])
    text = F.col("row").getField("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    # spans come by start; one that starts before the last one's end only prolongs it
    cut = F.aggregate("secrets", start, lambda acc, s: F.struct(
        F.when(s.start < acc.at, acc.out).otherwise(F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mark))).alias("out"),
        F.greatest(acc.at, s.end).alias("at")), lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return (found.withColumn("cleaned", F.when(F.size("secrets") == 0, text).otherwise(cut))
            .select(*(F.col("cleaned").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns)))
