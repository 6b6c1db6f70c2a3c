"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointbook.llm import bpe, decontaminate, lm_scoring, quality_knn, quality_rules, queries, secret_scan, sharding, simhash, suffix_array, suffix_dedup, token_counts
from pointbook.llm.pretokens import boundaries
from pointbook.llm.decontaminate import texts_from

LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(20_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, ids int, shard int, slot string, "
          "kept string, hits int, items string, n_words string, fingerprint string, score string, secrets int, body string, cut string, target int")
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, ""), (4, None), (None, "only words"), (None, None), (5, "é" * 300), (6, "a" * 400), (7, " \n\t "),
        (8, "password = abcdefghijkl1234"), (9, "x y z " * 40)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("r", 1, 2, "s", "k", 3, "i", "n", "f", "s", 4, "b", "c", 5)
    return spark.createDataFrame([(d, t, None if d == 5 else "en", None, None, *extra) for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "only words"), (1, "only words"), (2, None), (None, "x y"), (3, ""), (4, "one two three")], "item_id long, text string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, None), (9, None, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffix": lambda d, b, m: suffix_dedup.dedup(d),
    "bpe": lambda d, b, m: bpe.decode(bpe.encode(d, queries.RANKS), queries.RANKS),
    "bpe_one_pass": lambda d, b, m: bpe.recode(d, queries.RANKS),
    "shards": lambda d, b, m: sharding.number(sharding.assign(d, F.col("doc_id"), 3), 3, ["doc_id"]),
    "lm": lambda d, b, m: lm_scoring.score(d, m.where("quality = 1").select("doc_id")),
    "lm_other": lambda d, b, m: lm_scoring.score(d, m.where("quality = 1").select("doc_id"), background=d.select("doc_id", "text")),
    "decontaminate": lambda d, b, m: decontaminate.scan(d, b),
    "spans": lambda d, b, m: decontaminate.clean(d, b, mode="spans"),
    "knn": lambda d, b, m: quality_knn.classify(d, quality_knn.fit(d, m)),
    "secrets": lambda d, b, m: secret_scan.scan(d),
    "redact": lambda d, b, m: secret_scan.redact(d),
    "simhash": lambda d, b, m: simhash.fingerprints(d),
    "counts": lambda d, b, m: token_counts.prefix_counts(d, queries.WORD_VOCABULARY),
    "quality": lambda d, b, m: quality_rules.measure(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_keeps_rows_and_columns(spark, odd, items, marks, name):
    got = OPERATORS[name](odd, items, marks)
    assert got.count() == len(ROWS)
    assert set(odd.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(d) for d, _ in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_on_empty_tables(spark, odd, items, marks, name):
    assert OPERATORS[name](odd.limit(0), items.limit(0), marks.limit(0)).collect() == []


REPORTS = [suffix_dedup.report, sharding.shard_documents, secret_scan.report, simhash.report, quality_rules.report,
           lambda d: decontaminate.report(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0))]


@pytest.mark.parametrize("report", REPORTS)
def test_reports(spark, odd, report):
    assert report(odd).count() == len(ROWS) and report(odd.limit(0)).count() == 0


def test_defined_results(spark, odd, items):
    cut = {(r.doc_id, r.text): (len(r.kept), len(r.cut)) for r in suffix_dedup.dedup(odd).collect()}
    assert cut[1, LONG] == (len(LONG), 0) and cut[2, LONG] == (0, 1) and cut[4, None] == (0, 0) and cut[6, "a" * 400] == (400, 0)
    comp = [(r.doc_id, r.component_id) for r in simhash.report(odd).collect()]
    assert comp.count((2, 1)) == 2 and (4, 3) in comp and (7, 3) in comp and (None, 3) in comp
    hits = {r.doc_id: r for r in decontaminate.report(odd.where("doc_id is null and text is not null"), items).collect()}
    assert (hits[None].n_hit, hits[None].n_items) == (2, 1)
    assert [r.size for r in sharding.shard_documents(odd.where("doc_id = 4")).collect()] == [8]


def test_pipeline_stages(spark, odd, tmp_path):
    spark.createDataFrame([(1, "only words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, rows, str(tmp_path))
            n = got.count()
            assert n <= len(ROWS) and (k == len(corpus_pipeline.STAGES) - 1 or got.columns == rows.columns)
            if name in ("secret_scans", "byte_level_bpe"):
                assert n == rows.count()
            if name == "simhash_near_dedup" and rows is odd:
                assert [r.doc_id for r in got.collect()].count(2) == 0  # copies of document 1


def test_large_benchmark_in_parts(spark, odd, items):
    """A benchmark beyond the broadcast bound gives the same rows in several passes."""
    whole, parts = (sorted(map(str, decontaminate.scan(odd, items, keep=["doc_id"], broadcast_bytes=n).collect())) for n in (1 << 20, 30))
    assert whole == parts


def test_suffixes_against_sorting():
    """Order by the first symbols, and shared prefixes, for tiny queues on disk, recursion and small batches."""
    import random

    r, batch = random.Random(3), suffix_array.BATCH
    try:
        for _ in range(60):
            suffix_array.BATCH = r.choice([3, 17, 1 << 16])
            t = [r.randint(1, r.choice([1, 2, 26])) for _ in range(r.randint(1, 120))] * r.choice([1, 3])
            with suffix_array.Store(waiting=r.choice([5, 10**6]), held=r.choice([10, 10**9]), base=r.choice([0, 10**6])) as store:
                got = [(int(p), int(v)) for a, s in suffix_array.suffixes_descending(np.array(t, np.uint16), 50, store) for p, v in zip(a, s)]
            assert sorted(p for p, _ in got) == list(range(len(t)))
            heads = [t[p:p + 50] for p, _ in got]
            assert heads == sorted(heads, reverse=True)
            for x, y, (_, v) in zip(heads, heads[1:], got[1:]):
                assert v == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    finally:
        suffix_array.BATCH = batch


def test_pretokens_against_the_pattern():
    import random

    import public_tokenizers
    import regex

    pattern, r = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(list("ab's'tre ve ll\n\t   é9٣!’.-Ñ漢\U0001f600́")) for _ in range(r.randint(0, 40)))
        assert boundaries(texts_from([t])).tolist() == [len(t[:m.start()].encode()) for m in pattern.finditer(t)]


def test_only_segments_with_a_partner_of_their_key_are_sorted(monkeypatch):
    """A segment alone under its key goes round the sort; its copies' least doc and others' spans stay."""
    import pyarrow as pa

    sorted_, real = [], suffix_dedup.least_docs
    monkeypatch.setattr(suffix_dedup, "least_docs", lambda bodies, docs, width: (sorted_.extend(bodies), real(bodies, docs, width))[1])
    alone, long, short = bytes(range(60)), bytes(range(100, 170)), bytes(range(105, 160))
    rows = [(7, 7, 1, alone), (3, 5, 1, alone), (9, 9, 2, long), (4, 4, 2, short), (8, 8, 3, bytes(range(200, 255)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["least", "most", "shard", "body"])
    got = pa.Table.from_batches(list(suffix_dedup._judge(iter([batch]), 50))).to_pylist()
    assert sorted_ == [long, short]
    assert [(r["least"], r["spans"]) for r in got] == [(3, []), (9, [{"a": 5, "b": 60}])]


def test_shuffles_of_written_results_are_gone(spark, tmp_path):
    from pointbook.llm.common import shuffles_dropped

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "out"))
    assert spark.conf.get(name) == before and spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_lm_sends_a_task_s_word_once(spark, monkeypatch):
    """Words travel to their counts with a list of the partitions that need them, not once for each."""
    monkeypatch.setattr(lm_scoring, "PARTITION_WORDS", 50)
    text = " ".join(f"{a} common" for a in "abcdefghijklmnopqrstuvwxyz")
    src = spark.createDataFrame([(text, 6), (text, 6)], "text string, class int").coalesce(1)
    told = lm_scoring._word_counts(src).where("n > 1").select("w", "n", "t")
    needed = lm_scoring._needed(src, spark.sparkContext.broadcast(lm_scoring.Dealing(8, {})), told)
    got = needed.collect()
    assert "ps" in needed._jdf.queryExecution().analyzed().toString()
    assert len(got) == len({(r.p, r.w) for r in got}) and max(r.n for r in got) == 52
    assert len({r.p for r in got if r.n == 52}) > 1
