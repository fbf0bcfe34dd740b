"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.bpe import load_tokenizer
from agentlake.llm.common import slices

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
#: Distinct chunks a task remembers before it starts anew.
TABLE_CHUNKS = 1 << 18

# White space to Unicode, as the pre-tokenizer's \s; Python's own class has four more.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file, other counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: str = "text"):
    """Digest of the normalised content; the tokenizer has no normaliser, so only null becomes empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content. No cache yet: no rows."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
        stored.schema
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # An append that was run twice after a failure leaves equal rows.
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` for each ``content, text`` row.

    No token crosses from a non-space to the white space after it, so a text's count is the
    sum over chunks of white space with the word that follows. A chunk is encoded once per
    task.
    """

    def run(batches):
        tok = load_tokenizer(tokenizer)
        known: dict[str, int] = {}
        for part in slices(batches, "text"):
            chunks = [_CHUNK.findall(t) for t in part.column("text").to_pylist()]
            new = list({c for row in chunks for c in row if c not in known})
            if len(known) + len(new) > TABLE_CHUNKS:
                known.clear()
                new = list({c for row in chunks for c in row})
            pieces = [_halves(c) for c in new]
            missing = list({p for row in pieces for p in row if p not in known})
            for p, e in zip(missing, tok.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                known[p] = len(e.ids)
            for c, row in zip(new, pieces, strict=True):
                known[c] = sum(known[p] for p in row)
            counts = [sum(map(known.__getitem__, row)) for row in chunks]
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens bigint")


def _halves(chunk: str) -> tuple[str, ...]:
    """A chunk without its closing punctuation, and that: two pre-tokens, if a letter stands between."""
    body = chunk.rstrip(".,;:")
    if body and len(body) < len(chunk) and body[-1].isascii() and body[-1].isalpha():
        return body, chunk[len(body) :]
    return (chunk,)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``, counted through ``cache``.

    Contents that the cache lacks for this tokenizer version are encoded once each, whatever
    the number of rows that hold them, and appended to the folder ``cache``. A null text
    counts as empty, with 0 tokens. Keys may be null or repeated; each row gives one row.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    content = content_digest(text)
    keyed = docs.select(F.col(key).alias("key"), content.alias("content"))
    # One row per content; its text is fetched from the row with the smallest key.
    wanted = keyed.groupBy("content").agg(F.min("key").alias("key"))
    misses = wanted.join(read_cache(spark, cache, version), "content", "left_anti")
    texts = docs.select(F.col(key).alias("key"), content.alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.alias("t").join(
        misses.alias("m"), (F.col("t.content") == F.col("m.content")) & F.col("t.key").eqNullSafe(F.col("m.key")), "left_semi"
    )
    counted = encode_misses(found, tokenizer).dropDuplicates(["content"])
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    stored = read_cache(spark, cache, version)
    rows = docs.select(
        F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"), content.alias("content")
    )
    return rows.join(stored, "content").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
