"""Token counts by a digest cache: only contents without a stored count are encoded, each once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_bytes, shared_dir, slices, text_array, trimmed
from .encoding import encoder, version

SLICE = 1 << 20  # bytes of text that are encoded at a time
SCHEMA = "content binary, tokenizer string, n_tokens bigint"
_COUNTED = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])


def _encode(path: str):
    def run(batches):
        tool = encoder(path)
        for batch in trimmed(batches, path):
            texts = text_array(batch.column("text"))
            _, offsets = raw_bytes(texts)
            counts = [tool.counts(texts.slice(i, j - i)) for i, j in slices(offsets, SLICE)]
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("content").cast(pa.binary()), pa.array(n, pa.int64())], schema=_COUNTED)

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts at path; none where nothing is stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row of docs: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: a vocabulary file (.json: tokenizers, .model: sentencepiece) that every executor has.
    cache: a Parquet folder of counts by (content digest, tokenizer digest), read first and appended
    to; a new one in the shared folder if none is given. A digest that is stored twice counts once.

    Content is normalised only in ways that no tokenizer can see: null counts as empty. Texts are
    taken whole, without added special tokens. Equal texts share one count; a digest that a third of
    all rows have is joined as a skewed key. Null and repeated ids are kept as they are. Other
    columns are not looked at.
    """
    import uuid

    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    kind = version(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == kind)
    # the row of least id stands for its content: only its text is encoded, though all texts are moved to find it
    chosen = keyed.groupBy("content").agg(F.min(id_col).alias("least")).join(stored.select("content"), "content", "left_anti").withColumnRenamed("content", "wanted")
    misses = keyed.join(chosen, (F.col("content") == F.col("wanted")) & F.col(id_col).eqNullSafe(F.col("least")), "left_semi").select("content", "text")
    counted = misses.mapInArrow(_encode(tokenizer), "content binary, n_tokens bigint").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("content", F.lit(kind).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("tokenizer") == kind).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    lean = keyed.select(id_col, F.octet_length("text").cast("bigint").alias("n_bytes"), "content")
    return lean.join(counts, "content").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
