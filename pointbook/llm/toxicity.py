"""Toxicity: a learnt lexicon, found through misspellings, and weighed by its context.

* Lexicon: words and stems that stand in toxic documents far more often than
  chance allows (a bound on the binomial tail, corrected for the number of
  candidates), counted over a bounded sample of labelled documents.
* Search: Levenshtein automata intersected with the lexicon's trie
  (``edit_automaton``) tell for every distinct word which term it is or misspells.
* Weight: the log odds of a term at that number of edits, in the sample.
* Context: a hit inside quotation marks, or beside words of reporting, counts
  for a part; one beside words of address, or beside other hits, for more.
* Score: logistic regression on the sums of these weights, over the sample.

Every document is scored by its whole text; the text is all that is looked at.

Defined results: null and empty texts have no hits and get the score of a text
without any. Repeated rows are scored each. A document whose doc_id is null is
held out. Rows of ``labels`` with a null label are passed over; a document
labelled twice is learnt from twice. Without labels or hits to learn from, all
documents get a low prior score. Words are runs of letters, digits and
underscores in any script, in lower case.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, map_texts, written
from .edit_automaton import Automaton

# Labelled rows that are learnt from (those of the least hash of doc_id), and terms of the lexicon at most.
SAMPLE, LEXICON = 8192, 4096

# Stems have this many characters; whole words may have any number of them from the least on.
STEM_LEAST, STEM_MOST, WORD_LEAST = 4, 16, 3

# The chance, over all candidates, that the lexicon gets a term for nothing.
FALSE_TERMS = 0.01

# Documents that tell for a term at least, and different words before it, as a share of them: a passage that many
# documents share makes its rare words no terms.
LEAST_DOCS, VARIED = 3, 0.3

# Words around a hit that are its context, and what the context multiplies a hit's weight by.
WINDOW = 8
QUOTED, REPORTED, ADDRESSED, CROWDED = 0.25, 0.5, 1.25, 1.25

# Score from which a document is predicted to be toxic, and the chance of it before anything is seen.
THRESHOLD, PRIOR = 0.3, 0.1

# Words remembered by a worker, and prefixes counted in a task before they are handed on.
CACHE, COUNTED = 1 << 19, 1 << 20

WORD = re.compile(r"\w+")

# A quotation on one line between marks of one kind; a straight mark opens after a gap and closes before one.
QUOTE = re.compile(r"""“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’|(?<!\w)"[^"\n]*"(?!\w)|(?<!\w)'[^'\n]*'(?!\w)""")

MARKS = "“„«‘\"'"

# Words that report what others say or name a word, and words of address; fixed values.
REPORTING = frozenset("""said says say saying quote quoted quotes word words term terms called meaning means definition defined translated wrote
    dit mot mots terme cité citation signifie appelé sagte sagt wort wörter begriff zitat zitiert bedeutet genannt dijo dice palabra palabras
    término cita citado significa llamado""".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu toi ton ta vous votre du dich dir dein deine ihr euch sie tú ti usted ustedes eres te vosotros".split())


@dataclass
class Lexicon:
    """Terms (text, whether a stem), and the weight of each by edits."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    unseen: float = 0.0

    def weight(self, term: int, edits: int) -> float:
        return self.weights.get((term, edits), self.unseen if edits else 0.0)


class Finder:
    """Finds the lexicon's terms in texts; remembers the words it has judged."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.terms)
        self.judged: set[str] = set()
        self.found: dict[str, tuple[int, int]] = {}

    def judge(self, words: set[str]) -> None:
        if len(self.judged) > CACHE:
            self.judged, self.found = set(), {}
        new = sorted(words - self.judged)
        for s in range(0, len(new), 1 << 16):
            part = new[s:s + (1 << 16)]
            term, edits = self.automaton.run(part)
            self.judged.update(part)
            for i in np.flatnonzero(term >= 0).tolist():
                self.found[part[i]] = int(term[i]), int(edits[i])

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(term, edits, factor of its context) of each hit, in order."""
        text = text.lower()
        words = WORD.findall(text)
        distinct = set(words)
        self.judge(distinct)
        known = self.found
        if known.keys().isdisjoint(distinct):
            return []
        at = [i for i, w in enumerate(words) if w in known]
        quoted = self._quoted(text, at) if any(q in text for q in MARKS) else ()
        found = []
        for n, i in enumerate(at):
            around = words[max(0, i - WINDOW):i + WINDOW + 1]
            factor = QUOTED if i in quoted else 1.0
            if not REPORTING.isdisjoint(around):
                factor *= REPORTED
            if not ADDRESS.isdisjoint(around):
                factor *= ADDRESSED
            if n and i - at[n - 1] <= WINDOW or n + 1 < len(at) and at[n + 1] - i <= WINDOW:
                factor *= CROWDED
            found.append((*known[words[i]], factor))
        return found

    @staticmethod
    def _quoted(text: str, at: list[int]) -> set[int]:
        """Which of the words numbered ``at`` stand inside a quotation; only lines that hold one of them are looked at."""
        begin = [m.start() for m in WORD.finditer(text)]
        inside, end, spans = set(), -1, []
        for i in at:
            if begin[i] >= end:
                start = text.rfind("\n", 0, begin[i]) + 1
                end = text.find("\n", begin[i])
                end = len(text) if end < 0 else end
                line = text[start:end]
                spans = [(start + m.start(), start + m.end()) for m in QUOTE.finditer(line)] if any(q in line for q in MARKS) else []
                ends = [b for _, b in spans]
            n = bisect.bisect_right(ends, begin[i])
            if n < len(spans) and spans[n][0] <= begin[i]:
                inside.add(i)
        return inside

    def features(self, text: str) -> list[float]:
        """Weight of exact hits, weight of misspelled ones (both damped), and the heaviest hit."""
        sums, most = [0.0, 0.0], 0.0
        for term, edits, factor in self.hits(text):
            w = self.lexicon.weight(term, edits) * factor
            if w > 0:
                sums[edits > 0] += w
                most = max(most, w)
        return [math.log1p(sums[0]), math.log1p(sums[1]), most]


_finders: dict[str, Finder] = {}


def finder_of(lexicon: Lexicon) -> Finder:
    """This worker process's finder for the lexicon, with what it has learnt of words in earlier tasks."""
    key = repr((lexicon.terms, sorted(lexicon.weights.items()), lexicon.unseen))
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(lexicon)
    return _finders[key]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled rows that are not held out, written once."""
    learn = (labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    known = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id")  # at most ``sample`` rows
    return written(known, "toxicity")


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def candidates(known: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): documents of either label that hold each word or stem; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out():
            for toxic in (0, 1):
                terms = list(counts[toxic])
                n = [counts[toxic][t] for t in terms]
                zero = [0] * len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([t.rstrip(" ") for t in terms], pa.string()), pa.array([t[-1] != " " for t in terms], pa.bool_()),
                                                  pa.array(n if toxic else zero, pa.int64()), pa.array(zero if toxic else n, pa.int64())],
                                                 ["term", "stem", "toxic", "clean"])
                counts[toxic].clear()

        for batch in batches:
            for text, toxic in zip(_texts(batch, "text"), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                seen = set()
                for w in set(WORD.findall(text.lower())):
                    if len(w) >= WORD_LEAST:
                        seen.add(w + " ")  # a whole word
                    seen.update(w[:k] for k in range(STEM_LEAST, min(len(w), STEM_MOST + 1)))
                counts[int(toxic == 1)].update(seen)
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield from out()
        yield from out()

    rows = known.select("text", "toxic").mapInArrow(run, "term string, stem boolean, toxic bigint, clean bigint")
    return rows.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def strong(counted: DataFrame, toxic: int, clean: int, most: int = LEXICON) -> list[tuple[str, bool, int]]:
    """(term, stem, toxic documents) of the candidates beyond chance, the strongest first."""
    base = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    # Chernoff's bound: the chance of so many toxic documents among n is below exp(-strength).
    rest = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    scored = counted.where(F.col("toxic") >= LEAST_DOCS).withColumn("strength", F.round(F.col("toxic") * F.log(share / base) + rest, 9)).where(share > 2 * base)
    good = scored.where(F.col("strength") > math.log(max(scored.count(), 1) / FALSE_TERMS))
    rows = good.orderBy(F.desc("strength"), F.desc(F.length("term")), "stem", "term").limit(8 * most).collect()
    return [(r.term, r.stem, r.toxic) for r in rows]


def contexts(known: DataFrame, terms: list[tuple[str, bool, int]]) -> dict[tuple[str, bool], int]:
    """How many different words stand before each term in the toxic documents."""
    shared = known.sparkSession.sparkContext.broadcast({(t, stem): i for i, (t, stem, _) in enumerate(terms)})  # at most 8 * LEXICON terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = shared.value, set()
        whole, stems = {t for t, stem in index if not stem}, {t for t, stem in index if stem}
        sizes = sorted({len(t) for t in stems})

        def out():
            rows = sorted(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.string())], ["term", "before"])

        for batch in batches:
            for text in _texts(batch, "text"):
                words = WORD.findall(text.lower())
                if len(seen) > COUNTED:
                    yield out()
                for before, w in zip(["", *words], words):
                    if w in whole:
                        seen.add((index[w, False], before))
                    for k in sizes:
                        if k >= len(w):
                            break
                        if w[:k] in stems:
                            seen.add((index[w[:k], True], before))
        yield out()

    rows = known.where("toxic = 1").select("text").mapInArrow(run, "term int, before string").groupBy("term").agg(F.countDistinct("before").alias("n")).collect()
    return {terms[r.term][:2]: r.n for r in rows}


def choose(known: DataFrame, toxic: int, clean: int, most: int = LEXICON) -> list[tuple[str, bool]]:
    """The lexicon: of the candidates beyond chance, and not of one shared passage, the strongest; no stem and word of one family twice."""
    terms = strong(candidates(known), toxic, clean, most)
    varied = contexts(known, terms)
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    above: set[str] = set()
    for term, stem, docs in terms:
        if varied.get((term, stem), 0) < max(LEAST_DOCS, VARIED * docs):
            continue
        family = [term[:k] for k in range(STEM_LEAST, len(term) + (not stem))]
        if any(p in stems for p in family) or stem and term in above:
            continue
        chosen.append((term, stem))
        above.update(term[:k] for k in range(1, len(term) + 1))
        if stem:
            stems.add(term)
        if len(chosen) == most:
            break
    return sorted(chosen)


def weigh(known: DataFrame, terms: list[tuple[str, bool]], toxic: int, clean: int) -> Lexicon:
    """The weights of the terms by edits: log odds of the documents that hold them so."""
    lexicon = Lexicon(terms)
    shared = known.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = finder_of(shared.value), Counter()
        for batch in batches:
            for text, y in zip(_texts(batch, "text"), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                counts.update((t, e, int(y == 1)) for t, e in {(t, e) for t, e, _ in finder.hits(text)})
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([counts[k] for k in keys], pa.int64())],
                                         ["term", "edits", "toxic", "n"])

    rows = known.select("text", "toxic").mapInArrow(run, "term int, edits int, toxic int, n bigint").groupBy("term", "edits", "toxic").agg(F.sum("n").alias("n")).collect()
    seen: dict[tuple[int, int], list[int]] = {}
    for r in rows:  # at most LEXICON * 3 * 2
        seen.setdefault((r.term, r.edits), [0, 0])[r.toxic] += r.n

    def odds(p: int, n: int) -> float:
        return math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))

    lexicon.weights = {k: max(0.0, odds(p, n)) for k, (n, p) in seen.items()}
    # misspellings that the sample lacks weigh as all misspellings together do, at least nothing
    wrong = [v for (t, e), v in seen.items() if e]
    lexicon.unseen = max(0.0, min(odds(sum(p for _, p in wrong), sum(n for n, _ in wrong)), odds(1, 0)))
    return lexicon


def regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression (last: constant), by Newton steps; small ridge, no negative slope."""
    x = np.column_stack([x, np.ones(len(x))])
    on = x[:, :-1].any(0)
    ridge = np.r_[np.full(x.shape[1] - 1, 1.0), 1e-3]
    while True:
        w, use = np.zeros(x.shape[1]), np.r_[on, True]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + ridge * w
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h[np.ix_(use, use)], g[use])
            w[use] -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            return w
        on = on & (w[:-1] >= 0)


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the lexicon, its weights and the regression from the sample."""
    known = sample_of(docs, labels, sample)
    n = {r.y: r.n for r in known.groupBy((F.col("toxic") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return Model(Lexicon([]), np.array([0.0, 0.0, 0.0, math.log(PRIOR / (1 - PRIOR))]))
    lexicon = weigh(known, choose(known, toxic, clean), toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        finder = finder_of(shared.value)

        def run(texts: Texts) -> dict[str, pa.Array]:
            rows = [finder.features(t.decode("utf-8", "replace")) for t in texts.each()]
            return {f"f{i}": pa.array([r[i] for r in rows], pa.float64()) for i in range(3)}
        return run

    # a few numbers for each row of the sample
    rows = map_texts(known, "text", work, "f0 double, f1 double, f2 double", ["toxic"]).orderBy("f0", "f1", "f2", "toxic").collect()
    return Model(lexicon, regress(np.array([[r.f0, r.f1, r.f2] for r in rows]), np.array([float(r.toxic == 1) for r in rows])))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon and four numbers

    def work():
        m = shared.value
        finder = finder_of(m.lexicon)

        def run(texts: Texts) -> dict[str, pa.Array]:
            rows = [finder.features(t.decode("utf-8", "replace")) for t in texts.each()]
            return {"score": pa.array(m.score(np.array(rows).reshape(-1, 3)), pa.float64())}
        return run

    return map_texts(docs, "text", work, "score double", keep).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
