"""Problem 10: held-out accuracy on cut sentences, structures, lengths, and prefixes against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import truncation as t

THINGS = "order basket parcel locker ticket voucher carrier depot fleet meter".split()
SHAPES = ["The {0} keeps its old {1} until the next pass.", "Nobody owns the {0} since the {1} was moved.", "Reading the {0} from the cache costs less than asking the {1} again.", "After the {0} had been merged, its {1} was released by the agent.", "Every {0} names its {1} by id and never by position."]


def sentence(rng):
    return rng.choice(SHAPES).format(rng.choice(THINGS), rng.choice(THINGS))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 6)))
        if i % 5 == 0:
            at = rng.randrange(60, len(text) - 3)
            whole = text[at - 1] in ".! " and text[: at].rstrip().endswith(".")
            if not whole and text[at] != ".":
                text = text[:at]
                cut.add(i)
        elif i % 5 == 1:
            text = f"Merge {rng.choice(THINGS)} and {rng.choice(THINGS)}\n\n{text}\n\nReviewed: yes"
        elif i % 5 == 2:
            text = f"Merge {rng.choice(THINGS)} and {rng.choice(THINGS)}"
        rows.append((i, text, "log" if i % 2 else None))
    return rows, cut


def test_cut_sentences(spark, corpus):
    rows, cut = corpus
    extra = [(9000, None, "log"), (9001, "", "log"), (9002, " \n ", None), (9003, "Hmm...", "log"), (9004, "```\nlet a = [1,\n", "log"), (9005, "{\"a\": {\"b\": 1}}", "log"), (9006, "{\"a\": {\"b\": 1", "log"), (9007, "ends in half a sign�", "log")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string").withColumns({"cut": F.lit("clash"), "key": F.lit(1), "grams": F.lit(2)})
    got = t.cut_texts(df)
    assert got.count() == len(rows) + len(extra)
    found = {r.doc_id for r in got.where("cut").collect()}
    assert found >= {9004, 9006, 9007} and not found & {9000, 9001, 9002, 9005}
    found -= set(range(9000, 9010))
    assert len(found & cut) / len(cut) > 0.9 and len(found & cut) / len(found) > 0.9
    shares = {r.source: r for r in t.cut_shares(got).collect()}
    assert set(shares) == {"log", None} and sum(r.documents for r in shares.values()) == len(rows) + len(extra)
    assert t.cut_texts(df.limit(0)).count() == 0


def test_texts_cut_at_the_same_place_do_not_speak_for_each_other(spark):
    rng = random.Random(11)
    whole = [f"{sentence(rng)} {sentence(rng)} Nobody waits until the next pass." for _ in range(900)] + [f"{sentence(rng)} Take p of them first, since p is {i}." for i in range(20)]
    cut = [f"{sentence(rng)} {sentence(rng)} Number {i}. Nobody waits until the next p" for i in range(8)]
    # Sign-offs end alike too, with a word that goes on in another one.
    signed = [f"{sentence(rng)} Number {i}.\n\nReviewed: done" for i in range(12)] + [f"{sentence(rng)} It was done {i} days ago, and the dones are listed." for i in range(5)]
    texts = whole + cut + signed
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], "doc_id long, text string, source string")
    found = {texts[r.doc_id] for r in t.cut_texts(df).where("cut").collect()}
    assert set(cut) <= found and not found & set(signed)


def test_equal_texts_have_equal_answers(spark, corpus):
    rows, cut = corpus
    some = sorted(cut)[:5]
    more = [(8000 + i, rows[k][1], "other") for i, k in enumerate(some)]
    df = spark.createDataFrame(rows + more + more[:1], "doc_id long, text string, source string")
    answers = {r.doc_id: r.cut for r in t.cut_texts(df).collect()}
    assert [answers[8000 + i] for i in range(5)] == [answers[k] for k in some]


def test_prefixes_equal_brute_force(spark):
    rng = random.Random(3)
    whole = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(12)) + "." for _ in range(300)]
    texts = set(whole) | {w[: rng.randrange(22, len(w))] for w in whole[:80]} | {w[:30] + "..." for w in whole[80:90]} | {whole[5] + "\n\nbody"}
    # Openings that many texts share, in chains, across borders of partitions, some of which end at a line end first.
    base = "The list of tasks that the agents of this workspace hold"
    texts |= {base, base + "\n\nand more", base + " and runs them", base + " and", base[:20], base[:21], base[:22], *(f"{base} over {i} more tasks" for i in range(60)), *(f"{base}\n{i}" for i in range(60))}
    df = spark.createDataFrame([(x,) for x in sorted(texts)], "content string").withColumn("text", F.unhex(F.md5("content")))
    bare = {x: t.base_of(x)[0] for x in texts}
    want = {x for x in texts if any(y != x and len(bare[y]) > len(bare[x]) and t._breaks(bare[x], bare[y]) for y in texts)}
    assert base in want and base[:20] in want
    names = {bytes(r.text): r.content for r in df.collect()}
    for parts in ("1", "5", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {names[bytes(r.text)] for r in t.strict_prefixes(df.coalesce(3)).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_every_extension_of_a_prefix_is_asked(spark):
    base = "Reading the old list of tasks"
    texts = [base, base + "\nand more", base + " and runs them.", "The task w", "The task was stopped.", "Fix login", "Fix login for all users"]
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id for r in t.cut_texts(df).where("cut").collect()} >= {0, 3}
    assert {r.doc_id for r in t.cut_texts(df.where("doc_id <> 1")).where("cut").collect()} >= {0, 3}


def test_ends_are_looked_up_by_the_numbers_they_are_counted_by(spark):
    text = "The agent keeps " + "a/b/c" * 300 + " don't stop well-known GET /orders/:id aB1c_ 3f3f"
    read = t.read_texts(spark.createDataFrame([(b"1", text)], "text binary, content string"), spark.sparkContext.broadcast(frozenset()))
    (end,) = read.where("text is not null").collect()
    last = {r.gram for r in read.where("last = 1").collect()}
    assert set(end.grams) == last and len(last) == t.GRAMS and read.where("gram is not null").agg(F.sum("ended") + F.sum("went_on") + F.sum("last")).first()[0] == sum(len(t.tokens(text)) - i for i in range(t.GRAMS))


def test_piled_lengths(spark):
    rng = random.Random(9)
    rows = [("a", rng.randrange(20, 400)) for _ in range(600)] + [("a", 255)] * 40 + [("b", rng.randrange(20, 400)) for _ in range(600)]
    df = spark.createDataFrame([(s, n, n, None, 1) for s, n in rows], "source string, chars int, bytes int, decided boolean, n long")
    assert {(r.source, r.length) for r in t.piled_lengths(df).collect()} == {("a", 255)}


def test_a_cut_word_does_not_count_as_complete():
    kinds, _, words, counts = t._word_rows(["the whole thing th", "reading GET /orders/:id/lines now and /orders/:id/lin"])
    complete = {w: n for k, w, n in zip(kinds, words, counts) if k == 1}
    assert complete["the"] == 1 and "th" not in complete and "t" not in complete and "lin" not in complete
    assert {w for k, w in zip(kinds, words) if k == 2} == {"lines"}


def test_long_runs_take_linear_time():
    for text in ("x1y2" * 30_000, "a." * 50_000, "." * 100_000, "aB1" * 40_000, "a/b" * 40_000, "- " * 60_000, "0a" * 60_000, " " * 200_000 + "x"):
        base, marked = t.base_of(text)
        t.by_structure(base, marked)
        assert len(t.tokens(base)) <= len(base)
        t._word_rows([text])
