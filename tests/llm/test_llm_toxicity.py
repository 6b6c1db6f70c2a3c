"""Toxicity: the automaton against edit distances, features against a plain restatement, context, held-out accuracy, odd rows."""

import bisect
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointbook.llm import queries as q
from pointbook.llm import toxicity as tx
from pointbook.llm.edit_automaton import Automaton, edits_allowed

TERMS = sorted([("idiot", False), ("disgusting", False), ("worthless", False), ("scum", False), ("vequé", True), ("lostraschaft", True), ("idi", False), ("disgrace", True), ("bo", False)])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def judged(word, terms=TERMS):
    """(term, edits) by edit distances to whole words and, for stems, to every prefix of the word."""
    found = []
    for i, (t, stem) in enumerate(terms):
        e = min(distance(t, word[:k]) for k in range(len(word) + 1)) if stem else distance(t, word)
        if e <= edits_allowed(t, stem):
            found.append((e, -len(t), i))
    return (min(found)[2], min(found)[0]) if found else (-1, 0)


def misspelled(rng, word):
    for _ in range(rng.randint(0, 3)):
        i = rng.randint(0, len(word))
        word = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("aeiostdéx1") + word[i:], word[:i] + rng.choice("aeiostdéx1") + word[i + 1:]])
    return word


def test_automaton_equals_edit_distances():
    rng = random.Random(3)
    words = [misspelled(rng, rng.choice(TERMS)[0]) + rng.choice(["", "", "ung", "s", "🦊"]) for _ in range(3000)] + ["", "x", "zebra", "idiotidiot", "i" * 200]
    term, edits = Automaton(TERMS).run(words)
    for w, t, e in zip(words, term.tolist(), edits.tolist()):
        want = judged(w)
        assert e == want[1] and (t >= 0) == (want[0] >= 0), (w, t, e, want)
        if TERMS[t][1] is False:
            assert t == want[0], (w, t, want)
        elif t >= 0:  # of two stems and words at one distance the first complete stem may be told
            assert min(distance(TERMS[t][0], w[:k]) for k in range(len(w) + 1)) == e
    assert Automaton([]).run(["a", ""])[0].tolist() == [-1, -1]


def test_context_separates_quotation_from_abuse():
    lexicon = tx.Lexicon([("idiot", False)], {(0, 0): 4.0, (0, 1): 2.0})
    f = tx.Finder(lexicon)
    plain, quoted, reported, abuse, twice = (f.features(t) for t in (
        "that was an idiot thing", 'he wrote "what an idiot thing" there', "the term idiot is old", "you are an idiot, go", "an idiot and an idiot"))
    assert quoted[2] == 4 * tx.QUOTED * tx.REPORTED and reported[2] == 4 * tx.REPORTED < plain[2] == 4 < abuse[2] == 4 * tx.ADDRESSED
    assert twice == [math.log1p(8 * tx.CROWDED), 0, 4 * tx.CROWDED]
    assert f.features("an idjot") == [0, math.log1p(2.0), 2.0] and f.features("“an IDIOT”")[2] == 4 * tx.QUOTED
    assert f.features("don't say 'idiot' here")[2] == 4 * tx.QUOTED * tx.REPORTED and f.features("a 5\" idiot") == plain
    assert f.features("") == f.features("nothing here") == [0, 0, 0]
    long = "word " * 400_000 + "idiot " * 3 + "\"" * 50_000 + " word" * 400_000
    assert f.features(long)[2] > 0


def plain_features(text, lexicon):
    """Hits by edit distances, context by looking at every character."""
    text = text.lower()
    words = [(m.group(), m.start()) for m in re.finditer(r"\w+", text)]
    got = [(i, *judged(w, lexicon.terms)) for i, (w, _) in enumerate(words)]
    at = [g for g in got if g[1] >= 0]
    spans = [m.span() for m in tx.QUOTE.finditer(text)]
    exact, wrong, most = 0.0, 0.0, 0.0
    for i, t, e in at:
        w = lexicon.weight(t, e)
        near = {x for x, _ in words[max(0, i - tx.WINDOW):i + tx.WINDOW + 1]}
        w *= tx.QUOTED if any(a <= words[i][1] < b for a, b in spans) else 1
        w *= tx.REPORTED if near & tx.REPORTING else 1
        w *= tx.ADDRESSED if near & tx.ADDRESS else 1
        w *= tx.CROWDED if any(0 < abs(i - j) <= tx.WINDOW for j, _, _ in at) else 1
        exact, wrong, most = exact + w * (e == 0), wrong + w * (e > 0), max(most, w)
    return [math.log1p(exact), math.log1p(wrong), most]


def test_scores_equal_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = q.table(spark, sf, "documents"), q.table(spark, "/root/testdata/sf0.01", "labels")
    model = tx.fit(q.table(spark, "/root/testdata/sf0.01", "documents"), labels)
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    rows = docs.collect()
    cache = {}
    real = judged

    def remembered(w, terms):
        if w not in cache:
            cache[w] = real(w, terms)
        return cache[w]

    globals()["judged"] = remembered
    try:
        for r in rows:
            want = model.score(np.array([plain_features(r.text or "", model.lexicon)]))[0]
            assert got[r.doc_id] == pytest.approx(want, rel=1e-9), r.doc_id
    finally:
        globals()["judged"] = real


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = q.QUERIES["op13_toxicity"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.join(q.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert q.table(spark, sf, "documents").count() == got.count()
    pos, neg = [r.score for r in rows if r.toxic == 1], sorted(r.score for r in rows if r.toxic == 0)
    auc = sum(bisect.bisect_left(neg, s) + bisect.bisect_right(neg, s) for s in pos) / 2 / len(pos) / len(neg)
    caught, alone = sum(s >= 0.3 for s in pos) / len(pos), sum(s < 0.3 for s in neg) / len(neg)
    assert auc > 0.95 and caught > 0.9 and alone > 0.98, (auc, caught, alone)


def test_odd_rows(spark):
    rows = [(1, "you idiot", "s"), (2, None, "s"), (2, None, "s"), (None, "an idiot", "s"), (3, "", "s"), (4, "word " * 30_000, "s")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, score string, predicted string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 1, 1), (4, 1, None), (4, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (none, labels, labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = tx.score(docs, tx.fit(docs, marks))
        assert got.count() == len(rows) and set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        scores = {(r.doc_id, r.text): r.score for r in got.collect()}
        assert all(0 <= s <= 1 for s in scores.values()) and scores[2, None] == scores[3, ""]
        assert tx.report(docs, marks).where("doc_id is null").first().held_out
    assert tx.report(docs.limit(0), labels).collect() == []


def test_learns_a_stem_and_a_word(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            text[7] = "zwurg" + rng.choice("klmnopqr") + rng.choice("stuv")
        if i % 6 == 1:
            text[9] = "krimtal"
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 6 < 2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    assert ("krimtal", False) in model.lexicon.terms and ("zwurg", True) in model.lexicon.terms and len(model.lexicon.terms) <= 4
    new = spark.createDataFrame([(1, "you zwurgat"), (2, "the krimtal is"), (3, "the krimtol is"), (4, "abcdef"), (5, 'he said "krimtal"')], "doc_id long, text string")
    got = {r.doc_id: r.score for r in tx.score(new, model).collect()}
    assert min(got[1], got[2]) > 0.5 and got[4] < 0.1 and got[4] < got[3] and got[5] < got[2]
    assert {r.doc_id: r.score for r in tx.score(new.repartition(4), tx.fit(docs.repartition(7), labels)).collect()} == pytest.approx(got, rel=1e-9)
