"""The pipeline's stages on a corpus with planted cases, and the registry."""

import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry_points
import brute
import corpus_pipeline
from test_operators import TOKENIZER, prose
from tickloom.llm import idmap


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: clean prose, and documents made for each stage."""
    folder = str(tmp_path_factory.mktemp("sf"))
    pick = random.Random(3)
    rows = [(i, prose(1000 + i, 70), "en", "s", 1) for i in range(200)]
    labels = []
    for i in range(200):
        toxic = i % 4 == 0
        if toxic:
            words = rows[i][1].split()
            for k in (5, 25, 45):
                words[k] = pick.choice(["scoundrel", "nitwit"])
            rows[i] = (i, " ".join(words), "en", "s", 1)
        labels.append((i, int(toxic)))
    item, passage = prose(5000, 25), prose(5001, 60)
    rows += [
        (300, prose(1001, 70), "en", "s", 1),  # a copy of 1
        (301, prose(1002, 70) + " more", "en", "s", 1),  # nearly 2
        (302, prose(5002, 40) + "\n" + passage, "en", "s", 1), (303, passage + "\n" + prose(5003, 40), "en", "s", 1),
        (304, prose(5004, 40) + " " + item + " " + prose(5005, 40), "en", "s", 1),
        (305, None, None, None, None), (306, "", "en", "s", 0), (None, prose(5006, 30), "en", "s", 1),
        (307, "nitwit scoundrel nitwit", "en", "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, item, passage


def test_stages_take_effect(spark, corpus):
    folder, texts, item, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {i for i in range(0, 200, 4)} | {307}
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, folder).cache()
        state[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == before.columns
    assert set(state["toxicity"]) == set(texts) - toxic
    # the smallest id of each group stays, by the plain version of the join
    kept = {i: texts[i] for i in texts if i not in toxic}
    groups = brute.jaccard([(i, t) for i, t in kept.items() if i is not None])
    want = {i for i, (_, component, _) in groups.items() if component == i} | {None}
    assert set(state["jaccard_join"]) == want and {300, 301}.isdisjoint(want)
    cut = state["substring_dedup"]
    assert set(cut) == want and passage not in cut[303]["text"] and passage in cut[302]["text"]
    assert cut[303]["n_chars"] == len(cut[303]["text"])
    assert all(cut[i]["text"] == texts[i] for i in want if i not in (303,))
    left = state["decontamination"]
    assert set(left) == want - {304} and item in texts[304]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    for i, r in state["bpe"].items():
        text = left[i]["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert set(state["bpe"]) == set(left)


def test_run_is_the_stages_in_turn(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "bpe"]


def test_rows_of_one_id_are_told_apart(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line, own = prose(7001, 30), prose(7002, 30)
    rows = [
        (3, prose(7000, 80)), (7, prose(7000, 80) + " end"), (7, prose(7003, 80)),  # one of the two texts of 7 is linked
        (8, prose(7004, 80)), (8, prose(7004, 80)),  # equal rows
        (10, f"{line}\n{prose(7005, 60)}"), (11, f"{prose(7006, 9)}\n{line}\n{prose(7007, 60)}"), (11, f"{prose(7008, 9)}\n{own}\n{prose(7009, 60)}"),
        (None, prose(7010, 50)), (None, prose(7010, 50)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert one.schema == docs.schema
    got = sorted((str(r["doc_id"]), r["text"]) for r in one.collect())
    assert got == sorted((str(i), t) for k, (i, t) in enumerate(rows) if k not in (1, 4))
    cut = corpus_pipeline.cut_repeats(spark, one, "").collect()
    texts = [r["text"] for r in cut if r["doc_id"] == 11]
    assert len(cut) == len(rows) - 2 and rows[7][1] in texts and f"{prose(7006, 9)}\n{prose(7007, 60)}" in texts


def test_texts_without_evidence_stay_whatever_the_share_of_labels(spark, tmp_path):
    rows = [(i, prose(i, 60) + (" nitwit scoundrel" * 3 if i % 4 else "")) for i in range(200)] + [(300, None), (301, ""), (302, "?!"), (None, "")]
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert {300, 301, 302, None} <= left and not any(i % 4 for i in left if i is not None and i < 200)


def test_without_is_an_exact_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(i, str(i)) for i in range(500)] + [(None, "n"), (7, "again")], "doc_id long, text string")
    ids = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")
    want = sorted([t for i, t in ((i, str(i)) for i in range(500)) if i % 3] + ["n", "again"])
    assert sorted(r["text"] for r in idmap.without(docs, ids).collect()) == want
    # a full map rules nothing out, and the join decides
    monkeypatch.setattr(idmap, "marked", lambda ids: __import__("numpy").full(idmap._BYTES, 255, dtype="uint8"))
    assert sorted(r["text"] for r in idmap.without(docs, ids).collect()) == want
    assert idmap.without(docs.limit(0), ids).count() == 0


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in names) != 1] == [] and "pipeline" in names
    assert set(entry_points.oracle_sql()) <= set(names)
