"""Cases of the reviewer's findings: each failed before its change."""

from pointbook.llm import decontaminate
from pointbook.llm import lm_scoring as lm
from pointbook.llm import quality_rules as qr
from pointbook.llm import secret_scan as ss


def test_op10_fences_come_from_the_group(spark):
    """Symbols just below a former constant, and repeats below the base rule's 30%, lie outside; the group's own variety does not."""
    plain = [(i, 200, 1000 + i % 40, 0, 0, 0) for i in range(300)]
    few = [(1000 + i, 200, 1010, 0, 0, 8 + i % 2) for i in range(12)]
    tables = [(2000 + i, 200, 1000 + i, 110 + i, 0, 0) for i in range(6)]
    repeats = [(3000, 200, 1010, 0, 0, 58)]
    short = [(4000, 200, 820, 0, 0, 0)]
    frame = spark.createDataFrame([(*r, "en", "s") for r in plain + few + tables + repeats + short],
                                  "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.judge(frame, qr.fences(frame)).collect()}
    assert all(kept[r[0]] for r in plain + few)
    assert not any(kept[r[0]] for r in tables + repeats + short)


def guesses(text):
    return [text[a:b] for a, b, k in ss.find(text, ss.GuessCost()) if k == "guess"]


def test_op7_names_within_identifiers():
    for before, value in (("DB_PASSWORD=", "Tr0ub4dor&3!xQ9z"), ("DB_PWD: ", "X7f!q9Lz#2w"), ("userPwd=", "k3J#9sLw!zq"), ("dbpassword: ", "k3J#9sLw!zq"),
                          ("aws_secret_access_key = ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY"), ("PASSWORD_PROD=", "k3J#9sLw!zq"),
                          ("Authorization: Bearer ", "mF_9.B5f-4.1JqM"), ("authorization: basic ", "dXNlcjpxOXpYN2YjTHoy"), ("my api key: ", "k3J#9sLw!zq"),
                          ("url=https://h/x?token=", "k3J#9sLw!zq"), ("https://u:p@h password: ", "k3J#9sLw!zq"), ("credentials: ", "k3J#9sLw!zq")):
        assert guesses(f"so {before}{value} end") == [value], before
    for text in ("author: Maximilian-Hofmann", "spinning: wheel-of-Fortune-77", "secretary: Mary-Jane.Holloway", "compass: north-by-Northwest", "password reset: wheel-of-Fortune-77"):
        assert guesses(text) == [], text


def test_op7_values_beyond_a_base_span(spark):
    texts = ["password=Abcdefgh1234!$Zq9#kLw8 end", "password: Xq!9#0123456789abcdef$Lw", "password=abcdefgh1234 end"]
    assert [guesses(t) for t in texts] == [["Abcdefgh1234!$Zq9#kLw8"], ["Xq!9#0123456789abcdef$Lw"], []]
    got = ss.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.text for r in sorted(got)] == ["[secret] end", "password: [secret]", "[secret] end"]


def test_op4_scores_tell_rare_words_apart(spark):
    """9,000 words that are each seen more often fill any top list; the two fields differ in rarer ones only."""
    usual = [(i, " ".join(f"usual{(i * 90 + k) % 9000}" for k in range(180))) for i in range(200)]
    rare = [(1000, "alpha beta gamma delta"), (1001, "zeta eta theta iota"), (1002, "alpha beta gamma delta")]
    docs = spark.createDataFrame(usual + rare, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in [*range(100), 1000]], "doc_id long")
    got = {r.doc_id: r for r in lm.score(docs, ids, ["doc_id"]).collect()}
    assert got[1000].score < got[1001].score - 0.1
    assert got[1000].score == got[1002].score and got[1000].n_words == got[1002].n_words == 4
    new = spark.createDataFrame([(1, "alpha beta unseen beta"), (2, None), (3, "unseen")], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in lm.score(new, ids, ["doc_id"], docs).collect()} == {1: 4, 2: 0, 3: 1}


def test_op5_items_without_ids_are_hits(spark):
    docs = spark.createDataFrame([(1, "so one two three"), (2, "four five"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "four five")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, items).collect()}
    assert got == {1: (3, 0, True), 2: (2, 1, True), 3: (0, 0, False)}
    parts = decontaminate.scan(docs, items, keep=["doc_id"], broadcast_bytes=20).collect()
    assert {r.doc_id: (len(r.hits), r["items"]) for r in parts} == {1: (3, []), 2: (2, [7]), 3: (0, [])}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]
