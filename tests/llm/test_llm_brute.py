"""Each registered query against a brute-force version on the small tables."""

import base64
import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from pointbook.llm import queries as q
from pointbook.llm import secret_scan as ss
from pointbook.llm.token_counts import NEWER_LOWER

SF = "/root/testdata/sf0.001"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").collect()


def result(spark, name):
    rows = q.QUERIES[name](spark, SF).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, docs):
    got = result(spark, "op1_suffix_dedup")
    first = {}
    for d, t, *_ in sorted(docs):
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    for d, t, *_ in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, sha(kept))


def test_op2(spark, docs):
    got = result(spark, "op2_byte_bpe")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t, *_ in docs:
        ids = own.encode_ordinary(t)
        r = got[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))


def test_op3(spark, docs):
    rows = result(spark, "op3_sharding")
    by = {}
    for d, t, *_ in docs:
        r = rows[d]
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r)
        key, b, j = d, -1, 0  # the published loop, one key at a time
        while j < 24:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        assert r.shard == b
    for group in by.values():
        assert [r.slot for r in sorted(group, key=lambda r: r.doc_id)] == list(range(len(group)))


def test_op5(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(r.item_id)
    got = result(spark, "op5_decontaminate")
    for d, t, *_ in docs:
        w, hit, items = word.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    items |= found
                    hit |= set(range(i, i + n))
        ids = ",".join(sorted(map(str, items)))
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha(ids.encode()), bool(hit))


@pytest.mark.parametrize("part,other", [(None, False), (1500, False), (1500, True)])
def test_op4_against_plain_models(spark, docs, labels, monkeypatch, part, other):
    """Losses from plain dictionaries: shared vocabulary, absolute discounting. Also with many partitions and frequent
    words before dealt over several; and for documents that are not those of the models."""
    from pointbook.llm import lm_scoring as lm

    if part:
        monkeypatch.setattr(lm, "PARTITION_WORDS", part)
    good = {r.doc_id for r in labels if r.quality == 1}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {d: word.findall(lower(t)) for d, t, *_ in docs}
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    of_models = {d for d in texts if d % 2} if other else set(texts)
    got = {r.doc_id: r for r in lm.score(frame, spark.createDataFrame([(d,) for d in good], "doc_id long"), ["doc_id"],
                                         frame.where("doc_id % 2 = 1") if other else None).collect()}
    size = len({w for d in of_models for w in texts[d]}) + 1  # the vocabulary and the unknown word

    def counts(ids):
        c = Counter()
        for d in ids:
            c.update(zip(["<s>", *texts[d]], texts[d]))
        return c

    losses = []
    for c in (counts(good & of_models), counts(of_models)):
        uni, before, kept = Counter(), Counter(), Counter()
        for (h, w), n in c.items():
            uni[w] += n
            before[h] += n
            kept[h] += n - lm.DISCOUNT
        n_all = sum(uni.values())

        def loss(h, w, seen=c, uni=uni, before=before, kept=kept, n_all=n_all):
            p = (uni[w] + 1) / (n_all + size)
            lam = max(1 - kept[h] / before[h], 1e-12) if before[h] else 1.0
            add = (seen[h, w] - lm.DISCOUNT) / before[h] if (h, w) in seen else 0.0
            return -np.log(add + lam * p)
        losses.append(loss)
    assert set(got) == set(texts)
    for d in texts:
        pairs = list(zip(["<s>", *texts[d]], texts[d]))
        want = [sum(f(h, w) for h, w in pairs) / max(len(pairs), 1) for f in losses]
        assert got[d].n_words == len(pairs)
        assert np.allclose([got[d].target_loss, got[d].background_loss, got[d].score], [*want, want[0] - want[1]], atol=1e-4)


def test_op4_ranks_good_documents_lower(spark, labels):
    got = result(spark, "op4_lm_scoring")
    mean = lambda k: np.mean([got[r.doc_id].score for r in labels if r.quality == k])
    assert mean(1) < mean(0)


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in q.QUERIES["op6_quality_knn"](spark, sf).collect()}
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert np.mean([r.predicted == k for r, k in held]) > 0.97


def test_op7(spark, docs):
    got = result(spark, "op7_secret_scan")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    cost = ss.GuessCost()
    for d, t, *_ in docs:
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        r = got[d]
        n = Counter(k for _, _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], sha(text.encode()))
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] != "guess"] == [tuple(s.split(":")) for s in text.split(",") if s]
        assert all(cost(t[int(a):int(b)]) >= ss.MIN_LOG_GUESSES for k, a, b in spans if k == "guess")


def test_op7_guess_costs():
    """The dynamic program against all cuts of short values; planted values and placeholders."""
    cost = ss.GuessCost()

    def least(v, pieces, i=0):
        if i == len(v):
            return 0.0
        ways = [np.log10(ss._signs(v[i])) + least(v, pieces, i + 1)]
        ways += [c + least(v, pieces, b) for a, b, c in pieces if a == i]
        return min(ways)

    for v in ("pass1990", "aaaab12", "qwertyx", "p4ssword1", "20240131z", "Xk9#"):
        assert abs(cost(v) - least(v, list(cost.pieces(v)))) < 1e-9
    found = ss.find("db pwd: X7f!q9Lz#2w then pwd: changeme, https://u:Zx9!kQ4&vP@host and password=abcdefgh1234", cost)
    assert [k for _, _, k in found] == ["guess", "guess", "assign"]


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, distance):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    bits = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(bits[k + 1:] ^ bits[k]) <= distance):
            a, b = root(i), root(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op8(spark, docs):
    got = result(spark, "op8_simhash")
    prints = {d: fingerprint(t) for d, t, *_ in docs}
    want = reach(prints, 2)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_op8_crowds_and_chains(spark, distance):
    """A crowd around one fingerprint (more than a probed value may hold) and a chain of near ones."""
    import random

    from pointbook.llm import simhash

    r = random.Random(5)
    base, x = r.getrandbits(64), r.getrandbits(64)
    prints = [base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(200)]
    for _ in range(60):
        x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
        prints.append(x)
    prints += [r.getrandbits(64) for _ in range(100)] + [0, 0]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(prints)], "place long, fingerprint long")
    assert {r.place: r.first for r in simhash.label(df, distance).collect()} == reach(dict(enumerate(prints)), distance)


def test_op9(spark, docs):
    got = result(spark, "op9_token_counts")
    own = Tokenizer.from_file(q.WORD_VOCABULARY)
    for d, t, *_ in docs:
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 2048)


def test_op9_every_prefix():
    from pointbook.llm.token_counts import WordCounter

    counter, own = WordCounter(open(q.WORD_VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(q.WORD_VOCABULARY)
    for t in ("we've don't y'all're '", "worldly!!<|endoftext|>!x", "a<|startoftext|>", "tokens 12.5 émigré 漢字 ß", "", " ", "<|end"):
        counts = counter.counts([t])[0]
        assert [int(c) for c in counts] == [len(own.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]


def test_op9_all_code_points():
    """Every assigned code point, between words and alone, counts as the library counts it."""
    from pointbook.llm.token_counts import WordCounter

    counter, own = WordCounter(open(q.WORD_VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(q.WORD_VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Co",)
              and (unicodedata.category(chr(c)) != "Cn" or c in NEWER_LOWER or c in NEWER_LOWER.values())]
    for s in range(0, len(points), 8192):
        texts = [f"a{chr(c)}b {chr(c)}" for c in points[s:s + 8192]]
        want = [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
        got = counter.totals(texts)
        assert got == want, [hex(c) for c, a, b in zip(points[s:], got, want) if a != b]


def test_op9_totals_are_the_last_prefix_counts(spark):
    from pointbook.llm import token_counts

    docs = spark.createDataFrame([(1, "tokens 12.5 émigré we've"), (2, ""), (3, None), (4, "a<|startoftext|>b y'all're<|endoftext|>!x <|end")], "doc_id long, text string")
    got = token_counts.totals(token_counts.prefix_counts(docs, q.WORD_VOCABULARY), q.WORD_VOCABULARY)
    assert all(r.n_tokens == r.prefix_counts[-1] for r in got.collect()) and got.count() == 4


def test_op10(spark, docs):
    got = result(spark, "op10_quality_rules")
    for d, t, *_ in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def op10_verdicts(rows):
    """{doc_id: kept} of measured rows, restated with lists: fences of the first statistic, then of the others within them."""
    import math

    from pointbook.llm import quality_rules as qr

    def stats(r):
        return {"mean_word": r["word_chars"] / r["n_words"], "symbol_share": r["n_symbols"] / r["word_chars"],
                "dup_line_share": r["n_dup_lines"] / max(r["n_dup_lines"] + 1, r["n_words"] / 8), "repeat_share": r["n_repeat_words"] / r["n_words"]}

    def bucket_end(x):
        return math.exp(math.ceil(round(math.log(x) / math.log(qr.GROWTH), 9)) * math.log(qr.GROWTH)) if x > 0 else 0.0

    def fence(own, wide, sign):
        def at(p, tail):
            v = own if len(own) * (1 - tail) >= qr.MIN_GROUP * 0.25 - 1e-9 else wide
            p = p if sign > 0 else round(1 - p, 3)
            return v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]

        near, far = at(0.75, 0.75), at(0.25, 0.75)
        if near != far:
            return near + qr.REACH * (near - far)
        for p in qr.TAILS:
            if at(p, p) != at(0.5, p):
                return at(0.5, p) + qr.FAR / qr.NORMAL[p] * (at(p, p) - at(0.5, p))
        return at(qr.TAILS[-1], qr.TAILS[-1])

    inside = [r for r in rows if r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"]]
    kept = dict.fromkeys((r["doc_id"] for r in rows), False)
    for names in (qr.FENCED[:1], qr.FENCED[1:]):
        ok = []
        value = {r["doc_id"]: {k: (v, bucket_end(v)) for k, v in stats(r).items()} for r in inside}
        limits = {}
        for r in inside:
            key = r["lang"], r["source"]
            if key not in limits:
                limits[key] = {}
                for n in names:
                    own = sorted(value[x["doc_id"]][n][1] for x in inside if (x["lang"], x["source"]) == key)
                    wide = sorted(value[x["doc_id"]][n][1] for x in inside if x["lang"] == r["lang"])
                    limits[key][n] = (fence(own, wide, -1) if n in qr.LOWER_TOO else -math.inf, fence(own, wide, 1))
            if all(limits[key][n][0] <= value[r["doc_id"]][n][0] <= limits[key][n][1] for n in names):
                ok.append(r)
        inside = ok
    return kept | {r["doc_id"]: True for r in inside}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op10_verdict(spark, sf):
    from pointbook.llm import quality_rules as qr

    sf = f"/root/testdata/{sf}"
    rows = [r.asDict() for r in qr.measure(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    want = op10_verdicts(rows)
    assert {r.doc_id: r.kept for r in q.QUERIES["op10_quality_rules"](spark, sf).collect()} == want and 0 < sum(want.values()) < len(want)


def test_op10_verdict_does_not_depend_on_the_run(spark):
    from pointbook.llm import quality_rules as qr

    measured = qr.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")).drop("text")
    runs = [sorted((r.doc_id, r.kept) for r in qr.judge(m, qr.fences(m)).select("doc_id", "kept").collect()) for m in (measured, measured.repartition(13))]
    assert runs[0] == runs[1]


def test_pipeline(spark, docs):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    step = base
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF).persist()
        assert step.columns == base.columns
        seen[name] = {r.doc_id: r.text for r in step.collect()}
    verdict = result(spark, "op10_quality_rules")
    assert set(seen["quality_rules"]) == {d for d, r in verdict.items() if r.kept}
    prints = {d: fingerprint(t or "") for d, t in seen["quality_rules"].items()}
    assert set(seen["simhash_near_dedup"]) == set(reach(prints, 2).values())
    dirty = {d for d, r in result(spark, "op5_decontaminate").items() if r.contaminated}
    assert set(seen["benchmark_decontamination"]) == set(seen["simhash_near_dedup"]) - dirty
    assert set(seen["secret_scans"]) == set(seen["benchmark_decontamination"])
    spans = {d: r.spans for d, r in result(spark, "op7_secret_scan").items()}
    for d, t in seen["secret_scans"].items():
        assert ("[secret]" in t) == bool(spans[d]) and (spans[d] or t == seen["simhash_near_dedup"][d])
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(seen["secret_scans"]) and all(r.round_trip for r in last)


def test_vocabulary_files_are_parameters():
    assert json.load(open(q.WORD_VOCABULARY, encoding="utf-8"))["model"]["type"] == "BPE"
