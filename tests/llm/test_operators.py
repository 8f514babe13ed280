"""Each operator against a plain version, on rows with every awkward case."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from tickloom.llm import (
    bpe, components, decontaminate, fingerprint, htmltext, jaccard, langid, licenses, linededup, sharding, toxicity,
    wordhash,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, words):
    pick = random.Random(seed)
    syllables = "ba co di fu ga he ki lo mu na pe ri so tu va we xi yo zu".split()
    out = []
    for k in range(words):
        out.append("".join(pick.choice(syllables) for _ in range(pick.randint(1, 3))))
        if k % 9 == 8:
            out[-1] += "."
    return " ".join(out)


def frame(spark, rows):
    """(doc_id, text) rows with more columns, some of whose names the operators use themselves."""
    rows = [(i, t, "x", 1.5, 7) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, removed double, n long")


def awkward():
    """Null and empty texts, blanks, short, very long, equal, nearly equal and repeated rows, a null id."""
    long = prose(1, 30_000)
    near = prose(2, 120)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "Word"), (5, "word"), (6, "a b c d"), (7, "A B c  d"),
        (8, long), (9, long), (10, near), (11, near.replace(near.split()[60], "other", 1)), (12, near + " tail end"),
        (13, "é Ü 中文 😀"), (14, "é Ü 中文 😀"), (15, prose(3, 40)), (16, "x" * 70_000), (17, "…!? --"), (None, near),
    ]


# ---------------------------------------------------------------- helpers
def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (100, 300), (300, 200), (7, 7), (None, 3), (5, None)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 toxicity
def toxic_rows():
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(i, 60)
        if toxic:
            words = text.split()
            for k in (10, 30, 50):
                words[k] = random.Random(i + k).choice(["scoundrel", "nitwit", "blockhead"])
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_is_held_out(spark):
    rows, labels = toxic_rows()
    extra = [(1000, None), (1001, ""), (1002, "?!"), (None, "nitwit"), (1003, prose(9, 20_000)), (5, rows[5][1])]
    docs = frame(spark, rows + extra)
    votes = spark.createDataFrame(
        [(i, t, "q") for i, t in labels] + [(None, 1, "q"), (1003, None, "q"), (3, 1, "q"), (3, 0, "q")],
        "doc_id long, toxic int, text string",
    )
    out = toxicity.toxicity(docs, votes).collect()
    assert len(out) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in out}
    held = [i for i, _ in rows if by_id[i]["held_out"]]
    assert held and all(by_id[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert by_id[1000]["score"] == by_id[1001]["score"] == by_id[1002]["score"] < 0.5
    assert by_id[None]["held_out"] is False
    # the labels of held-out rows are not read
    turned = votes.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r["doc_id"], r["n_words"]): r["score"] for r in toxicity.toxicity(docs, turned).collect()}
    assert again == {(r["doc_id"], r["n_words"]): r["score"] for r in out}


def test_toxicity_counts_equal_those_of_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 500)  # tasks hand out their nodes many times
    rows, labels = toxic_rows()
    label = {i: t for i, t in labels if i % 5}
    rows = [(text, label.get(i)) for i, text in rows] + [(None, 1), ("", 0), ("Ä \u00e9t\u00e9 a abc abcd abcde " * 3, None)]
    known = spark.createDataFrame(rows, "text string, toxic int").repartition(5)
    want = brute.toxic_evidence(rows)
    body = b"".join(want)
    ends = np.cumsum([0, *map(len, want)])
    # every prefix is a text of one word
    numbers, _ = wordhash.hash_words(np.frombuffer(body, dtype=np.uint8), ends, wordhash.ALNUM)
    expected = dict(zip(numbers.view(np.int64).tolist(), want.values()))
    got = {r["node"]: r["e0"] for r in toxicity.evidence_table(known).collect() if r["e0"]}
    assert len(want) > 3 and got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert [r["predicted"] for r in out] == [0, 0]
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


# ---------------------------------------------------------------- 2 languages
def test_languages_and_mixtures(spark):
    pick = random.Random(4)
    spoken = {"one": "ka ke ki ko ku ta te ti".split(), "two": "schra zwo pfle grau tz".split()}

    def say(lang, n):
        return " ".join("".join(pick.choice(spoken[lang]) for _ in range(2)) for _ in range(n))

    rows = [(i, say(lang, 30), lang) for i in range(60) for lang in ["one" if i % 2 else "two"]]
    rows += [(100, None, "one"), (101, "", "two"), (102, "12 … 3", "one"), (103, "中文", None), (104, "😀 №", "two"), (None, say("one", 30), None)]
    rows += [(105, say("one", 60) + " " + say("two", 20), None), (106, say("two", 40_000), None), (7, rows[7][1], "one")]
    docs = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, score int")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["lang_pred"] == x for i, _, x in rows[:60])
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102, 104)] == ["und"] * 4 and by_id[100]["score"] == 0
    assert by_id[103]["lang_pred"] in spoken and by_id[None]["lang_pred"] == "one" and by_id[106]["lang_pred"] == "two"
    mixed = by_id[105]
    assert (mixed["lang_pred"], mixed["n_languages"]) == ("one", 2) and 0.65 < mixed["score"] < 0.85
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_languages_of_a_text_do_not_depend_on_its_neighbours(spark):
    pick = random.Random(5)
    starts = "b d f g k l".split()

    def say(lang, n):
        return " ".join("".join(starts[lang] + pick.choice("aeiou") for _ in range(2)) for _ in range(n))

    rows = [(i, say(i % 6, 40), str(i % 6)) for i in range(120)]
    rows += [(200, " ".join(say(k, 40) for k in range(6)), None)]  # more than four languages
    rows += [(300 + i, " ".join(say(k % 2, 1) for k in range(5 + i % 7)), None) for i in range(60)]
    rows += [(400 + i, say(i % 6, 1000), None) for i in range(200)]  # a full slice has many more words than 2^17
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = langid.learn(docs)
    together = {r["doc_id"]: tuple(r) for r in langid.predict(docs.coalesce(1), langs, table).collect()}
    alone = {r["doc_id"]: tuple(r) for r in langid.predict(docs.where("doc_id < 400").repartition(8), langs, table).collect()}
    assert alone == {i: r for i, r in together.items() if i < 400}
    assert together[200][3] == 6 and abs(together[200][2] - 1 / 6) < 0.05


def test_languages_of_a_long_text_are_summed_over_pieces():
    import numpy as np

    pick = random.Random(6)
    table = np.log(np.random.default_rng(1).dirichlet(np.ones(langid.CELLS), 3)).astype(np.float32)
    text = np.frombuffer(" ".join(pick.choice(["ab", "cde", "x" * 90, "Fé", "12 "]) for _ in range(3000)).encode(), dtype=np.uint8)
    chances, _ = langid._word_chances(text, np.array([0, len(text)]), table)
    whole, size = langid.mixtures(lambda: [(chances, np.array([0]))], 1)
    for kept in (0, 500, 1 << 20):
        pieces = langid._long_text(text, 0, len(text), table, 64, kept)
        assert np.array_equal(np.concatenate([c for c, _ in pieces()]), chances)
        share, n = langid.mixtures(pieces, 1)
        assert n == size and np.allclose(share, whole, atol=1e-4)
    assert langid._long_text(np.full(500, 32, dtype=np.uint8), 0, 500, table, 64) is None


# ---------------------------------------------------------------- 3 sharding
def test_shards_fit_and_split_no_further_than_needed(spark):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(300)] + [(1000, "y" * 9000), (1001, None), (1001, ""), (None, "z")]
    rows += [(2000, "same" * 100)] * 20
    limit = 4000
    out = sharding.assign(frame(spark, rows), limit=limit).collect()
    assert len(out) == len(rows)
    sizes, members = {}, {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        members.setdefault(r["shard"], []).append(r)
    names = sorted(sizes)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))  # no bucket inside another
    for shard, inside in members.items():
        assert {(r["shard_bytes"], r["depth"]) for r in inside} == {(sizes[shard], len(shard))}
        assert all(r["oversized"] == (sizes[shard] > limit) for r in inside)
        if sizes[shard] > limit:
            assert len({r["doc_id"] for r in inside}) == 1  # one row, or rows of one key
        if shard:  # the bucket it was split from did not fit
            assert sum(n for s, n in sizes.items() if s.startswith(shard[:-1])) > limit
    slots = sharding.directory(sharding.assign(frame(spark, rows), limit=limit)).orderBy("first_slot").collect()
    assert slots[0]["first_slot"] == 0
    assert all(a["last_slot"] < b["first_slot"] for a, b in zip(slots, slots[1:]))
    assert sharding.assign(frame(spark, [])).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark, [(i, prose(i, 50)) for i in range(50)])
    sharding.write(docs, str(tmp_path / "out"), limit=3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 3000").count() == 0


def test_written_shards_hold_null_and_repeated_keys_once(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (7, "c"), (7, "c"), (7, None), (8, "d" * 50)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, _key int")
    sharding.write(docs, str(tmp_path / "keys"), limit=60)
    got = spark.read.parquet(str(tmp_path / "keys")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


# ---------------------------------------------------------------- 4 line dedup
def test_line_dedup_keeps_the_first_and_reports_offsets(spark):
    passage = prose(50, 60)
    common = "See you soon."
    rows = [
        (1, f"{prose(51, 30)}\n{passage}\n{common}"),
        (2, f"{prose(52, 30)}\n{passage.upper()}\né {prose(53, 30)}\n{common}"),
        (3, f"é intro here. {passage} {prose(54, 30)}"),
        (4, f"{passage}"),
        (5, prose(55, 30)), (6, None), (7, ""), (8, common), (9, " \n \n"), (None, passage), (10, prose(56, 20_000)),
        (11, f"{prose(57, 40)}\n{prose(58, 40)}\n{prose(57, 40)}"),
    ]
    docs = frame(spark, rows)
    out = {r["doc_id"]: r for r in linededup.dedup(docs).collect()}
    texts = dict(rows)
    for i, r in out.items():
        if texts[i] is None:
            assert r["text"] is None
            continue
        left, at = "", 0
        for s in r["removed"]:
            left, at = left + texts[i][at: s["start"]], s["end"]
        assert r["text"] == left + texts[i][at:]
    unchanged = (1, 5, 6, 7, 8, 9, None, 10)
    assert all(out[i]["text"] == texts[i] and not out[i]["removed"] for i in unchanged)
    assert passage.upper() not in out[2]["text"] and out[2]["text"].endswith(common) and "é" in out[2]["text"]
    assert out[4]["text"] == "" and out[3]["text"].startswith("é intro here.") and len(out[3]["removed"]) == 1
    assert out[11]["text"].count(prose(57, 40)) == 1
    assert out[1]["score"] == "x" and set(out[1].asDict()) == set(docs.columns)
    twice = linededup.report(docs.union(docs.where("doc_id = 5"))).where("doc_id = 5").collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    assert linededup.dedup(frame(spark, [])).count() == 0


def test_line_dedup_takes_every_later_line_and_sentences_of_any_script(spark):
    wide = "".join(chr(0x4E00 + 37 * k) + ("。" if k % 12 == 11 else "") for k in range(36))
    inside = "These two sentences are whole in it. Both stand here again."
    rows = [
        (1, "Short line.\nOne. Two.\nfirst\nA stock word. new"), (2, "short  LINE.\nonly here\nOne. Two.\nand here\nfirst"),
        (3, "Short line."), (4, "Two. other\nOne. other\nA stock word. more"), (5, f"前文。{wide}"), (6, f"別的。{wide}尾。"),
        (7, f"{prose(1, 5)}. {inside} {prose(2, 5)}"), (8, f"{prose(3, 5)}. {inside} {prose(4, 5)}"), (9, "x\nx\nx"),
    ]
    out = {r["doc_id"]: r for r in linededup.report(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert all(out[i]["text"] == texts[i] and out[i]["n_removed"] == 0 for i in (1, 4, 5, 7))
    assert out[2]["text"] == "only here\nand here\n" and out[2]["n_removed"] == 3
    assert out[3]["text"] == "" and out[6]["text"] == "別的。尾。" and out[9]["text"] == "x\n"
    assert inside not in out[8]["text"] and out[8]["text"] == f"{prose(3, 5)}. {prose(4, 5)}"
    for text in [*texts.values(), "a...b. c?! d\n\n e.", "", "。。」 x！？\n", "a.\n", "..", "é。é"]:
        spans = linededup.units(text.encode())
        assert "".join(text.encode()[a:b].decode() for a, b in spans) == text


# ---------------------------------------------------------------- 5 Jaccard join
@pytest.mark.parametrize("group", [jaccard.GROUP, 8])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)  # small blocks visit one another
    rows = [r for r in awkward() if r[0] is not None]
    pick = random.Random(6)
    base = prose(60, 200).split()
    # a family of copies of copies, and boilerplate that unrelated documents share
    family = [base]
    for k in range(150):
        words = list(pick.choice(family))
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(len(words))] = f"new{k}"
        family.append(words[pick.randint(0, 12):])
        rows.append((100 + k, " ".join(family[-1])))
    rows += [(400 + k, prose(61, 30) + " " + prose(400 + k, 25)) for k in range(120)]
    out = {r["doc_id"]: tuple(r[1:]) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert out == brute.jaccard(rows)


def test_jaccard_join_of_null_ids_repeated_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    out = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert out == [(3, 2, 3, 2), (3, 2, 3, 2), (5, 2, 3, 2), (None, 0, None, 0), (None, 2, None, 0)]
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 6 main text
def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_main_text_by_elements():
    text = htmltext.main_text(
        page(
            "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>"
            "<article><header><h1>Title &amp; more</h1></header><p>One\n <b>two</b><br>three<p>fo&#117;r&nbsp;&copy;"
            "<script>var a = '<p>no</p>';</script><!-- <p>no</p> --><form><p>no</p></form><ul><li>a<li>b</ul>"
            "<div class=comments><p>no</p></div><div id='share-box'>no</div></article><aside>no</aside><footer>no</footer>"
        ),
        {},
    )
    assert text == "Title & more\nOne two three\nfour ©\na\nb"
    assert htmltext.main_text("", {}) == "" and htmltext.main_text("plain &lt;b&gt; text", {}) == "plain <b> text"
    assert htmltext.main_text("<p>cut &am", {}) == "cut &am"
    assert htmltext.main_text("<div>" * 5000 + "deep" + "</div>" * 3000, {}) == "deep"
    assert htmltext.main_text("<p title='a>b' don't>x</p><p hidden>y</p><a href='", {}) == "x"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = []
    for i in range(12):
        menu = "<div class=m1><a href=/a>Start</a> <a href=/b>Shop now</a></div>"
        note = "<div class=x7><p>Our offices are open from nine to five.</p></div>"
        rows.append((i, "http://Site.example:80/p", page(f"{menu}<div class=t><h2>{prose(i, 6)}</h2><p>{prose(i + 50, 40)}</p></div>{note}")))
    article = f"<article><h1>Same</h1><p>{prose(99, 30)}</p></article>"
    rows += [(50 + k, "http://site.example/copy", page(article)) for k in range(6)]
    rows += [(70, None, page("<p>Our offices are open from nine to five.</p>")), (71, "http://other.example/", None), (None, "x", ""), (72, "http://site.example/z", page(article))]
    rows.append(rows[0])
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = htmltext.extract(pages).collect()
    assert len(out) == len(rows)
    by_id = {r["page_id"]: r for r in out}
    for i in range(12):
        assert by_id[i]["text"] == f"{prose(i, 6)}\n{prose(i + 50, 40)}"
    assert by_id[50]["text"] == by_id[72]["text"] == f"Same\n{prose(99, 30)}"
    assert by_id[70]["text"] == "Our offices are open from nine to five."
    assert by_id[71]["text"] == by_id[None]["text"] == "" and by_id[None]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_style_tree_decides_inside_landmarks(spark):
    rows = []
    for i in range(12):
        tag = "article" if i % 2 else "main"
        body = f"<h2>{prose(i, 6)}</h2><p>{prose(i + 50, 40)}</p><div class=few><p>Common to few: {i // 4}</p></div>"
        note = "<div class=x7><p>Our offices are open <a href=/n>from nine</a> to five.</p></div>"
        rows.append((i, f"http://{tag}.example/{i}", page(f"<{tag}>{note}{body}{note}</{tag}>")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert out == {i: f"{prose(i, 6)}\n{prose(i + 50, 40)}\nCommon to few: {i // 4}" for i in range(12)}


def test_main_text_is_not_lost_by_names():
    text = "".join(f"<p>{prose(k, 20)}</p>" for k in range(4))
    want = "\n".join(prose(k, 20) for k in range(4))
    for body in (
        f"<div class='content with-sidebar'><article>{text}</article></div>",
        f"<div class='site no-sidebar'><nav>{prose(9, 200)}</nav><main>{text}</main></div>",
        f"<form id=aspnetForm><article>{text}</article></form><p>tail</p>",
        f"<form id=aspnetForm><div>{text}</div></form>",
        f"<div class=sidebar><div class=widget><main>{text}</main></div></div><div class=ads>{prose(8, 300)}</div>",
        f"<article>{text}</article><aside class=related><article>{prose(7, 9)}</article></aside><div class=ad-300x250>no</div>",
        f"<div>{text}</div><div class='sidebar right'><article>card</article></div><div id=site-footer>no</div>".replace("<article>card</article>", "card"),
    ):
        assert htmltext.main_text(page(body), {}) == want
    parts = "<h2 id=social-policy>a</h2><h2 id=comments>b</h2><section id=related-work>c</section><p class=share-price>d</p><div class=header>e</div>"
    assert htmltext.main_text(page(f"<article>{parts}{text}</article>"), {}) == f"a\nb\nc\nd\ne\n{want}"


# ---------------------------------------------------------------- 7 BPE
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    pick = random.Random(8)
    odd = ["a", "the ", " ", "  ", "\n", "'s", "1", ".", "é", " ", "<|endoftext|>", "<|endo", "text|>", "中", "😀", "́", "\x85"]
    rows = awkward() + [(100 + k, "".join(pick.choice(odd) for _ in range(4000))) for k in range(6)]
    rows += [(200, " " * 5000), (201, "ab" * 40_000), (202, prose(1, 30_000)[777:])]
    out = bpe.round_trip(frame(spark, rows), TOKENIZER).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r[1:]) for r in out} == want
    assert bpe.round_trip(frame(spark, []), TOKENIZER).count() == 0


def test_bpe_repairs_joins_of_small_chunks(monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CUT_BITS", 3)
    monkeypatch.setattr(bpe, "LEAST", 4)
    library = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = bpe.ChunkEncoder(bpe.Vocabulary(file.read()))
    for text in (prose(70, 300), prose(70, 300)[5:], "no-spaces-at-all" * 50, " \n" * 200 + "x", "don't we'll 12 345" * 30):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        (ids,) = bpe.encode_texts(data, np.array([0, len(data)]), encoder)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.reused > 20


# ---------------------------------------------------------------- 8 decontamination
def test_contamination_equals_a_plain_scan(spark):
    item = prose(80, 30)
    words = item.split()
    items = [
        (1, item), (2, prose(81, 12)), (3, "Quick brown"), (4, "zz"), (5, None), (6, "?!"), (7, item), (7, prose(82, 14)),
        (None, prose(83, 15)), (8, "one two three four five six seven eight nine"),
    ]
    rows = awkward() + [
        (100, f"{prose(84, 50)} {' '.join(words[5:18])} {prose(85, 50)}"),
        (101, " ".join(words[5:14])), (102, " ".join(words[5:15]).upper()), (103, "the QUICK, brown fox"),
        (104, "zz zz, zz"), (105, prose(83, 15)), (106, item + " " + item), (107, prose(82, 14) + " zz"),
        (108, "eight nine one two three four five six seven eight nine ten"),
    ]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    out = {r["doc_id"]: tuple(r[1:]) for r in decontaminate.contamination(frame(spark, rows), bench).collect()}
    want = brute.contamination(rows, items)
    want[None] = (want[None][0], 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert out == want and out[102][4] and not out[101][4]
    clean = decontaminate.contamination(frame(spark, rows), bench.limit(0)).where("contaminated").count()
    assert clean == 0 and decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_contamination_tells_rows_of_one_id_apart(spark):
    item = prose(80, 30)
    rows = [(1, "two words"), (1, item), (1, item), (2, None), (2, item[:9]), (None, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.contamination(frame(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in out) == [
        ("1", 2, 0, False), ("1", 30, 30, True), ("1", 30, 30, True), ("2", 0, 0, False), ("2", len(item[:9].split()), 0, False), ("None", 30, 0, False)
    ]
    left = decontaminate.without_contaminated(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert sorted(str(r["text"]) for r in left.collect()) == sorted(str(t) for i, t in rows if i != 1 or t != item)
    named = spark.createDataFrame([("a", item, 1), ("b", "x", 2)], "doc_id string, text string, digest int")
    assert [r["doc_id"] for r in decontaminate.without_contaminated(named, bench).collect()] == ["b"]


# ---------------------------------------------------------------- 9 fingerprints
def test_fingerprints_of_edits_and_neighbours(spark):
    rows = awkward() + [(20, prose(2, 120)), (21, "b.\na."), (22, "a.\nb.")]
    out = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    ordered = [(-1 if i is None else i, t) for i, t in rows]
    for i, (n, sha) in brute.edits(ordered).items():
        r = by_id[None if i == -1 else i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
    assert by_id[8]["near_next"] == 1.0 and by_id[8]["fingerprint"] == by_id[9]["fingerprint"]
    assert by_id[10]["fingerprint"] == by_id[20]["fingerprint"] != by_id[11]["fingerprint"]
    assert by_id[21]["fingerprint"] == by_id[22]["fingerprint"]  # the order of paragraphs does not count
    assert by_id[10]["near_next"] > 0.6 > by_id[9]["near_next"]
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next"))
    few = fingerprint.fingerprints(frame(spark, rows), parts=3)
    assert sorted(map(str, few.collect())) == sorted(map(str, out))
    single = fingerprint.fingerprints(frame(spark, [(1, "abcd")])).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abca").hexdigest() and single["near_next"] == 1.0
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_paragraphs_are_inserted_and_deleted(spark):
    rows = spark.createDataFrame([("p one.\np two.", "p three. more.", "p two.\np three. more.\np one.")], "a string, b string, c string")
    for name in "abc":
        rows = fingerprint.with_vector(rows, name, f"v{name}")
    row = rows.select(
        (fingerprint.add(F.col("va"), F.col("vb")) == F.col("vc")).alias("put"),
        (fingerprint.subtract(F.col("vc"), F.col("vb")) == F.col("va")).alias("taken"),
    ).first()
    assert row["put"] and row["taken"]


# ---------------------------------------------------------------- 10 licenses
def test_licenses_are_found_and_worded(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = awkward() + [
        (100, f"{prose(90, 30)}\n{notice}\n{prose(91, 30)}"), (101, notice.upper()),
        (102, "This file is licensed under the Apache License, Version 2.1."), (103, "A licence to fish is not that."),
        (104, "All rights reserved.\nReleased under the MIT License."), (105, prose(92, 9_000) + " Released under the MIT License."),
    ]
    out = {}
    for r in licenses.scan(frame(spark, rows + [rows[-6]])).collect():
        out.setdefault(r["doc_id"], []).append(r)
    # 102 is of another version, so it is another license
    assert set(out) == {100, 101, 104, 105}
    assert len(out[100]) == 2 and {(r["license"], r["line"], r["differences"]) for r in out[100]} == {("Apache-2.0", 1, "")}
    assert out[100][0]["start"] == len(prose(90, 30)) + 1
    assert out[101][0]["license"] == "Apache-2.0" and out[101][0]["wording"] == 1.0
    assert sorted(r["license"] for r in out[104]) == ["All-rights-reserved", "MIT"] and out[105][0]["license"] == "MIT"
    # the ranking by compression agrees with an exhaustive alignment on every template
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        best = max(scanner.names, key=lambda n: (scanner.confirm(text, n)[0], len(scanner.words[n])))
        assert scanner.block(text.encode())[0] == best == name
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licenses_over_lines_beside_one_another_and_at_block_edges(spark):
    import textwrap

    names = ["MIT-grant", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-or-later", "AGPL-3.0-or-later", "GPL-2.0"]
    rows = []
    for i, name in enumerate(names):
        wrapped = textwrap.wrap(licenses.TEMPLATES[name], 60)
        rows.append((i, f"{prose(i, 20)}\n/*\n" + "\n".join(f" * {x}" for x in wrapped) + f"\n */\n{prose(i + 40, 20)}"))
    rows += [(20, "Code under the MIT License, docs under CC BY 4.0."), (21, "code is released under the MIT License, docs are licensed under CC BY 4.0.")]
    rows.append((22, " ".join(licenses.TEMPLATES.values())))
    # every edge of a long run of cues
    rows += [(100 + k, "license " * 40 * k + licenses.TEMPLATES["MIT-grant"] + " license" * 900) for k in range(20)]
    out = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    for i, name in enumerate(names):
        assert [(r["license"], r["wording"], r["line"], r["differences"]) for r in out[i]] == [(name, 1.0, 2, "")]
        assert out[i][0]["start"] == len(prose(i, 20)) + 7
    assert [r["license"] for r in out[20]] == [r["license"] for r in out[21]] == ["MIT", "CC-BY-4.0"]
    assert sorted(r["license"] for r in out[22]) == sorted(licenses.TEMPLATES)
    for k in range(20):
        assert [(r["license"], r["wording"], r["start"]) for r in out[100 + k]] == [("MIT-grant", 1.0, 320 * k)]


def test_versions_and_names_of_licenses_are_obligatory(spark):
    gpl = licenses.TEMPLATES["GPL-2.0-or-later"]
    rows = {
        0: licenses.TEMPLATES["BSD-2-Clause"], 1: licenses.TEMPLATES["BSD-3-Clause-terms"], 2: licenses.TEMPLATES["ISC"],
        3: "This text is licensed under CC BY-ND 4.0.", 4: "Licensed under CC BY-NC-SA 4.0.", 5: "Licensed under CC BY-NC-ND 4.0.",
        6: gpl.replace("version 2", "version 1"), 7: "Licensed under the Apache License, Version 1.1.", 8: "Licensed under CC BY 3.0.",
        9: "Released under the Apache License.", 10: "This work is licensed under the GNU Lesser General Public License, version 3.",
        11: gpl.replace("program", "package"),
    }
    found = {i: set() for i in rows}
    for r in licenses.scan(frame(spark, list(rows.items()))).collect():
        found[r["doc_id"]].add(r["license"])
    named = {0: "BSD-2-Clause", 1: "BSD-3-Clause-terms", 2: "ISC", 3: "CC-BY-ND-4.0", 4: "CC-BY-NC-SA-4.0", 5: "CC-BY-NC-ND-4.0"}
    named |= {10: "LGPL-3.0", 11: "GPL-2.0-or-later"}
    assert found == {i: {named[i]} if i in named else set() for i in rows}


def test_every_template_is_found_by_its_own_wording_alone():
    """All templates against the text of every one, and with each obligatory word replaced."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        best = scanner.block(text.encode())
        assert best[0] == name and best[2] == 1.0 and best[3] == ""
        for word in scanner.must[name]:
            at = text.lower().rindex(word)
            other = text[:at] + "zz9" + text[at + len(word):]
            assert name not in {m.license for m in scanner.matches(other.encode())}
