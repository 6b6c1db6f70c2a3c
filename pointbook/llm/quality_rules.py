"""Quality rules whose thresholds adapt to each language and source.

Text statistics come from built-in functions. Quantile sketches of each
statistic per language and source replace fixed cutoffs: fences are drawn from
the quartiles, or from outer quantiles where the quartiles coincide, and the
documents are joined with the fences of their group. DataFrame functions only.

A sketch is a table of counts by logarithmic bucket (values within
``GROWTH`` of each other share one), so sketches merge by adding counts:
exactly, in any order. Equal documents give equal fences and verdicts however
they are partitioned and however often the job is run. A quantile is the
bucket's upper end, at most ``GROWTH`` - 1 above the exact one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Statistics with a fence. The fences of the first are drawn first, and the
# sketches of the others are of the documents within them: one kind of junk
# does not widen the fences of the next statistic.
FENCED = ("mean_word", "symbol_share", "dup_line_share", "repeat_share")
LOWER_TOO = ("mean_word",)

# Fences lie this many spreads (quartile distances) outside the quartiles.
REACH = 3.0

# Where the quartiles coincide, the spread is the gap from the median to the
# first of these quantiles that differs from it. Gaps count by the normal
# distribution's, so that a fence is as far out as by quartiles; where all
# are the same, the last one is the fence.
NORMAL = {0.75: 0.6745, 0.9: 1.2816, 0.95: 1.6449, 0.975: 1.96}
TAILS = (0.9, 0.95, 0.975)
FAR = NORMAL[0.75] * (1 + 2 * REACH)

# Ratio of the ends of a sketch's buckets, and the least documents for quartiles
# of a group's own: 30, and 75, 150 and 300 for the outer quantiles, which leaves
# the same number beyond each. A smaller group takes the quantile of its
# language, merged from the sketches of its sources.
GROWTH = 1.005
MIN_GROUP = 30

# Fences of up to this many groups are broadcast (some 100 bytes each).
BROADCAST_GROUPS = 100_000

# The fixed base rule.
BASE_WORDS, BASE_REPEAT = 20, 30


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (bigint) of the text.

    A null or empty text has 0 of each. Input columns of these names are replaced.
    """
    keep = [c for c in df.columns if c not in COUNTS]
    body = F.col("body")
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.select("row", "body", F.transform(F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"), lines.alias("lines"))
    last = F.size("words") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    out = out.select(
        "row", F.size("words").cast("bigint").alias("n_words"), F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(last >= 1, window).alias("windows"))
    # only a text with a window found twice is sorted
    order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("order", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), order)).drop("windows")
    again = F.transform("order", lambda x, k: F.when((F.get("order", k - 1).h == x.h) | (F.get("order", k + 1).h == x.h), x.i))
    out = out.withColumn("again", F.array_sort(F.filter(again, lambda i: i.isNotNull()))).drop("order")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("again", start, lambda acc, i: F.struct(
        (acc.n + i + WINDOW - F.greatest(i, acc.end)).alias("n"), (i + WINDOW).alias("end")), lambda acc: acc.n)
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def shares() -> dict[str, Column]:
    """The statistics that have fences, from the counts; of documents with words."""
    words = F.col("n_words").cast("double")
    lines = F.greatest(F.col("n_dup_lines") + 1, F.col("n_words") / 8).cast("double")
    return {"mean_word": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / F.col("word_chars").cast("double"),
            "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words}


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


def sketch(stats: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Sketches per language and source: (lang, source, stat, bucket, n). ``bucket`` is NULL for the value 0."""
    each = stats.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names))).alias("s"))
    bucket = F.when(F.col("s.value") > 0, F.ceil(F.round(F.log(F.col("s.value")) / math.log(GROWTH), 9)).cast("int"))
    return each.groupBy("lang", "source", F.col("s.stat").alias("stat"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], names: tuple[str, ...], shares_: list[float], prefix: str) -> DataFrame:
    """Per ``keys``: ``<prefix>n`` (documents), and ``<prefix><stat>_<i>``, the statistic's quantile of each share, from running counts."""
    merged = sketches.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "stat")  # at most some thousand buckets
    value = F.coalesce(F.exp(F.col("bucket") * F.lit(math.log(GROWTH))), F.lit(0.0))
    at = merged.select(*keys, "stat", value.alias("value"), F.sum("n").over(w).alias("all"),
                       F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    picked = [F.min(F.when((F.col("stat") == n) & (F.col("upto") >= F.col("all") * p - 1e-9), F.col("value"))).alias(f"{prefix}{n}_{i}")
              for n in names for i, p in enumerate(shares_)]
    return at.groupBy(*keys).agg(F.max("all").alias(f"{prefix}n"), *picked)


# The shares whose quantiles fences are drawn from, on either side.
SHARES = sorted({0.25, 0.5, 0.75, *TAILS, *(round(1 - p, 3) for p in TAILS)})


def _drawn(stats: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per language and source of ``stats``: of_lang, of_source and the fences of ``names``."""
    sketches = written(sketch(stats, names), "sketches")
    own = quantiles(sketches, ["lang", "source"], names, SHARES, "own_")
    wide = quantiles(sketches, ["lang"], names, SHARES, "all_")
    both = own.alias("o").join(wide.alias("w"), F.col("o.lang").eqNullSafe(F.col("w.lang")))

    def fence(n: str, sign: int) -> Column:
        def at(p: float, tail: float) -> Column:
            """The quantile ``p`` (from the other end below) of the sketch that has documents enough beyond ``tail``."""
            i = SHARES.index(p if sign > 0 else round(1 - p, 3))
            return F.when(F.col("own_n") * (1 - tail) >= MIN_GROUP * 0.25 - 1e-9, F.col(f"own_{n}_{i}")).otherwise(F.col(f"all_{n}_{i}"))

        near, far = at(0.75, 0.75), at(0.25, 0.75)
        steps = [F.when(near != far, near + REACH * (near - far))]
        for p in TAILS:
            middle, outer = at(0.5, p), at(p, p)
            steps.append(F.when(outer != middle, middle + FAR / NORMAL[p] * (outer - middle)))
        return F.coalesce(*steps, at(TAILS[-1], TAILS[-1]))

    sides = [(n, s) for n in names for s in ((1, -1) if n in LOWER_TOO else (1,))]
    return both.select(F.col("o.lang").alias("of_lang"), F.col("o.source").alias("of_source"),
                       *(fence(n, s).alias(f"{'hi' if s > 0 else 'lo'}_{n}") for n, s in sides))


def _fenced(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``df`` (lang, source) with the fences of its groups, null where a group has none.

    The fences, one row a group, are broadcast up to ``BROADCAST_GROUPS``
    groups, counted first; beyond, it is a plain join in which Spark splits
    the partitions of a hot group.
    """
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    return df.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")


def _within(stats: dict[str, Column], names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [
        F.coalesce(stats[n] <= F.col(f"hi_{n}"), F.lit(True)) & (F.coalesce(stats[n] >= F.col(f"lo_{n}"), F.lit(True)) if n in LOWER_TOO else F.lit(True))
        for n in names])


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per language and source: ``lo_*`` and ``hi_*`` of each statistic.

    Sketches are aggregated before the shuffle, so a hot source costs one row
    per task. Null languages and sources are groups of their own. Documents
    that fail the base rule are not part of any sketch, and those outside the
    first statistic's fences not of the others'. A value on a fence is inside.
    """
    stats = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *(c.alias(n) for n, c in shares().items()))
    first, rest = FENCED[:1], FENCED[1:]
    outer = written(_drawn(stats, first), "fences")
    inside = _fenced(stats, outer).where(_within({n: F.col(n) for n in first}, first)).select("lang", "source", *rest)
    inner = _drawn(inside, rest).withColumnsRenamed({"of_lang": "in_lang", "of_source": "in_source"})
    return outer.join(inner, F.col("of_lang").eqNullSafe(F.col("in_lang")) & F.col("of_source").eqNullSafe(F.col("in_source")), "left").drop("in_lang", "in_source")


def judge(measured: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``base_failed`` and ``kept``: the base rule holds and every statistic is within the fences of the group.

    A group without fences has no document that passed the base rule.
    """
    keep = [c for c in measured.columns if c not in ("base_failed", "kept")]
    packed = measured.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), *COUNTS)
    held = _fenced(packed, bounds)
    within = _within(shares(), FENCED)
    failed = base_failed()
    kept = F.when(failed, F.lit(False)).otherwise(within)
    return held.select(*(F.col("row").getField(c).alias(c) for c in keep), failed.alias("base_failed"), kept.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    measured = written(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return judge(measured, written(fences(measured), "fences")).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, in their own columns. A null text is rejected, as it has no words."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")
    measured = written(measure(packed).drop("text"), "quality")
    return judge(measured, written(fences(measured), "fences")).where("kept").select("row.*")
