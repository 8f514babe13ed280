"""Quality rules, importance resampling and spelling variants against plain versions."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from test_operators import awkward, frame, prose
from tickloom.llm import quality, resampling, spelling


# ---------------------------------------------------------------- 11 quality rules
def junk(seed, words):
    return " ".join(f"{w}{'*#$%'[k % 4] * 3}" for k, w in enumerate(prose(seed, words).split()))


def judged(spark, rows, labels, **options):
    votes = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    return quality.quality(frame(spark, rows), votes, **options).collect()


def test_quality_keeps_what_reads_like_trusted_text(spark):
    rows = [(i, junk(i, 80) if i % 3 == 0 else prose(i, 80)) for i in range(120)]
    labels = [(i, int(i % 3 != 0), "q") for i in range(60)] + [(None, 1, "q"), (7, 0, "q"), (8, None, "q"), (500, 1, "q"), (2, 5, "q")]
    out = {r["doc_id"]: r for r in judged(spark, rows, labels)}
    assert all(out[i]["kept"] == (i % 3 != 0) for i in range(120))
    assert not any(r["base_failed"] for r in out.values())


def test_quality_surface_counts(spark):
    rows = awkward() + [
        (20, "a b c " * 30), (21, "x\ny\nx\n\n \n \nx"), (22, "a a a a"), (23, "# * $ % & | < > é# <p>"), (24, "one word here"),
        (25, prose(4, 49)), (26, prose(4, 50)), (26, prose(4, 50)), (27, "a b c d a b c\nd a b c"), (28, "l1 l\r\nl1 l\r\nl1 l"),
    ]
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in judged(spark, rows, [])
    )
    short = {i for i, t in rows if len(t or "") > 20_000}  # the plain version is quadratic
    want = sorted(
        (i is None, i or 0, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])
        for i, t in rows if i not in short for c in [brute.surface(t)]
    )
    assert [g for g in got if g[1] not in short] == want
    assert len(got) == len(rows)


def test_quality_bounds_and_empty_tables(spark):
    assert judged(spark, [], []) == []
    labels = spark.createDataFrame([(i, 1) for i in range(2_000)], "doc_id long, quality int")
    some = quality.trusted_ids(labels, 500).count()
    assert 350 < some < 650 and quality.trusted_ids(labels, 2_000).count() == 2_000
    # ids of another type, and a verdict that does not depend on how the rows are dealt
    rows = [(f"d{i}", prose(i, 60)) for i in range(30)] + [("", None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    votes = spark.createDataFrame([(f"d{i}", 1) for i in range(9)], "doc_id string, quality int")
    one = sorted(map(str, quality.quality(docs.coalesce(1), votes).collect()))
    assert one == sorted(map(str, quality.quality(docs.repartition(7), votes).collect()))


def test_quality_counts_every_trusted_text_without_a_broadcast(spark, monkeypatch):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(None, prose(41, 60)), (3, prose(42, 60))]
    votes = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1)], "doc_id long, quality int")
    assert quality.trusted_ids(votes).count() == 30
    docs = frame(spark, rows)
    counts = lambda: sorted(map(tuple, quality.fit(docs, quality.trusted_ids(votes), 4096).collect()))
    flags = lambda: sorted(map(str, quality._flagged(docs, quality.trusted_ids(votes)).collect()))
    want, marked = counts(), flags()
    assert sum("good=True" in m for m in marked) == 31
    monkeypatch.setattr(quality, "MAX_BROADCAST", 5)
    assert counts() == want and flags() == marked
    narrow = votes.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert sorted(map(tuple, quality.fit(docs, quality.trusted_ids(narrow), 4096).collect())) == want


# ---------------------------------------------------------------- 12 importance resampling
@pytest.mark.parametrize("orders, buckets, percent", [(1, 10_000, 10), (3, 997, 35)])
def test_resampling_equals_plain_version(spark, orders, buckets, percent):
    rows = awkward() + [(30 + i, prose(i, 25)) for i in range(60)] + [(40, prose(10, 25)), (90, "A-b_c  D"), (91, "Ünï ÀB 中文 x"), (92, "a"), (93, "a b")]
    target = [prose(i, 40) for i in range(5)] + [None, "", prose(3, 40)]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    out = resampling.resample(frame(spark, rows), items, orders=orders, buckets=buckets, percent=percent).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out), key=str)
    want = brute.resampled(rows, target, orders, buckets, 20, percent)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    # equal ids and scores may take their ranks in either order
    assert sorted(g[4] for g in got if g[4]) == sorted(w[4] for w in want if w[4])
    by = lambda rows: sorted((r[4], r[3], r[0]) for r in rows if r[4])
    assert by(got) == by(want)


def test_resampling_of_empty_tables_and_too_many_buckets(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), nothing).count() == 0
    out = resampling.resample(frame(spark, [(1, prose(1, 30))] * 10), nothing).collect()
    assert sorted((r["rank"] or 99) for r in out) == [1] + [99] * 9
    with pytest.raises(ValueError):
        resampling.hashed(frame(spark, []), 1, 1 << 20)


# ---------------------------------------------------------------- 13 spelling variants
def spelled(spark, rows, **options):
    out = spelling.variants(frame(spark, rows), **options).collect()
    assert len({r["word"] for r in out}) == len(out)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in out}


def test_spelling_equals_comparing_all_pairs(spark):
    pick = random.Random(5)
    words = ["".join(pick.choice("abé") for _ in range(pick.randint(6, 10))) for _ in range(60)]
    rows = [(i, " ".join(pick.choice(words) for _ in range(400))) for i in range(12)]
    rows += [(50, None), (51, ""), (None, "Wordings wordings"), (52, "ÀÉÎÕÜàé ÀÉÎÕÜàé"), (53, "aaaaaaaaaa aaaaaaaaaa aaaaaaaaa aaaaaaaaa"), (54, "ab" * 3_000), (54, "ab" * 3_000)]
    # a chain of forms: 2, 20 and 200 occurrences, each one edit from the next, and a tie of two forms
    rows += [(60, "xenophon " * 200 + "xenophons " * 20 + "xenophonsy " * 2 + "zqqqqqq " * 2 + "zqqqqqa " * 40 + "zqqqqqb " * 40)]
    assert spelled(spark, rows, slip=7) == brute.spellings(rows, slip=7)
    got = spelled(spark, rows, slip=10**9)
    assert got == brute.spellings(rows, slip=10**9)
    assert got["xenophonsy"][2:] == ("xenophons", 20, "xenophon") and got["zqqqqqq"][2] == "zqqqqqa"


@pytest.mark.parametrize("letters, low, high", [("ab", 4, 9), ("abcdefghijklmnopqrstuvwxyz", 7, 16), ("abc", 30, 60)])
def test_pivots_miss_no_near_word(letters, low, high):
    """Every edit of random words, where bigrams repeat and tie, meets by the keys."""
    pick = random.Random(7)
    words = {"".join(pick.choice(letters) for _ in range(pick.randint(low, high))) for _ in range(400)}
    for w in list(words)[:150]:
        i = pick.randrange(len(w))
        words |= {x for x in (w[:i] + w[i + 1:], w[:i] + pick.choice(letters) + w[i:], w[:i] + pick.choice(letters) + w[i + 1:], w + pick.choice(letters), pick.choice(letters) + w) if len(x) >= 4}
    held = {}
    for w in words:
        for g in {w[i: i + 2] for i in range(len(w) - 1)}:
            held[g] = held.get(g, 0) + 1
    ranks = {g: i for i, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
    index, met = {}, set()
    for w in words:
        prefix, last = spelling.prefix_places(w, ranks)
        for k in spelling.posting_keys(w, prefix):
            index.setdefault(k, []).append((w, last))
    for w in words:
        prefix, last = spelling.prefix_places(w, ranks)
        a, b = spelling.pivot_places(prefix)
        cost = {(f, t): x + y for x, (f, _) in prefix.items() for y, (_, t) in prefix.items() if t - f >= 2}
        assert cost[a, b] == min(cost.values())
        for k in spelling.probe_keys(w, (a, b)):
            met |= {frozenset((w, v)) for v, v_last in index.get(k, []) if v != w and last <= v_last}
    listed = sorted(words)
    near = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[i + 1:] if abs(len(a) - len(b)) <= 1 and brute.one_edit(a, b)}
    assert near and near <= met


def test_spelling_of_no_rows_and_wrong_options(spark):
    assert spelled(spark, []) == {} and spelled(spark, [(1, "short words"), (2, None)]) == {}
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, []), min_length=3)
