"""The corpus pipeline: toxicity, Jaccard join, substring dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and gives it to the next one.  All stages but the last return the
columns of the documents; rows without doc_id pass the stages that compare
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, idmap, jaccard, linededup, toxicity
from tickloom.llm.queries import load, tokenizer
from tickloom.session import cut_lineage


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, or no higher than that of a text without evidence.

    Null and empty texts, and texts of neutral words alone, so stay whatever the
    share of toxic labels; a null id or repeated rows change nothing.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    score, words = _fresh(docs, "score"), _fresh(docs, "n_words")
    spared = (F.col(score) < 0.5) | (F.col(score) <= model.no_evidence)
    return toxicity.with_scores(docs, model, score=score, words=words).where(spared).drop(score, words)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked documents, and equal rows of one doc_id once."""
    twice = idmap.repeated_ids(docs)
    if twice.isEmpty():
        groups = jaccard.jaccard_components(docs)
        return idmap.without(docs, groups.where("doc_id <> component_id").select("doc_id"))
    # rows of one doc_id with other texts are documents of their own
    keyed = idmap.with_row_keys(docs, twice)
    groups = jaccard.jaccard_components(keyed)
    kept = cut_lineage(idmap.without(keyed, groups.where("doc_id <> component_id").select("doc_id")))
    # only rows with a digest can have others of their key; of those the least is kept
    may = F.coalesce(F.col("doc_id.digest") != 0, F.lit(False))
    others = [c for c in docs.columns if c != "doc_id"]
    one = kept.where(may).groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("row"))
    one = one.select(*["doc_id" if c == "doc_id" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return idmap.without_row_keys(kept.where(~may).union(one))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages that an earlier document holds are cut; documents that had nothing else go."""
    removed = _fresh(docs, "removed")
    cut = linededup.dedup(docs, removed=removed, min_line=1)
    text = F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))
    kept = cut.where((F.size(removed) == 0) | (F.coalesce(F.length(text), F.lit(0)) > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts and rows without id stay."""
    return decontaminate.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left; a null text is an empty one."""
    return bpe.round_trip(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
# toxicity, the similarity join and BPE have no SQL form; the stages are tested against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
