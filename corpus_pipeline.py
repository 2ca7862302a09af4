"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's result as
Parquet and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderbook.llm import langid
from ladderbook.llm.common import table, written
from ladderbook.llm.near_copies import near_copies, row_hash
from ladderbook.llm.packing import pack
from ladderbook.llm.queries import domain_of, mixture
from ladderbook.llm.suffix_dedup import suffix_dedup

TOKENIZER = "word_bpe_49k.json"
#: the mixture takes nine tenths of the tokens that are left
SHARE = "tokens * 9 div 10"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject. They learn from the stage's own labelled rows.

    Texts that are null or have no letter are rejected. If no row is labelled, nothing can be told, and
    all texts with a letter stay.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")
    kept = langid.identify(rows, model).filter(~F.col("rejected"))
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of the five-word runs of a pair are common):
    that of least id; rows without an id come last. Of rows equal in id and text one stays.
    """
    found = near_copies(docs.select("doc_id", "text"))
    chosen = written(found.select(F.col("lead").alias("_lead")).distinct(), "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), row_hash("doc_id", "text").alias("_row"))
    # the chosen rows grow with the documents: one way to join them at every size
    kept = rows.join(chosen.hint("merge"), F.col("_row") == F.col("_lead"), "left_semi")
    if not found.groupBy("row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_row"])
    return kept.select("_doc.*")


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that also start earlier; n_chars counts what is left.

    A document of which nothing is left goes; one that was empty before stays.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").alias("_doc"), "text")
    kept = suffix_dedup(rows, "_doc", kept_as="text").filter("n_removed = 0 or kept <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, each once."""
    place = {"_domain": domain_of(F.col("source")), "_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))}
    taken = mixture(docs.select("doc_id", "text", "lang", "source"), F.expr(SHARE), 1, 11)
    taken = taken.select(F.col("doc_id").alias("_id"), *[F.col(c[1:]).alias(f"{c}2") for c in place]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for c, value in place.items():
        same = same & (value == F.col(f"{c}2"))
    return docs.join(taken.hint("merge"), same, "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Models, suffix arrays and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
