"""Token counts of whole texts, through a digest cache.

Contents are normalised (null is empty; runs of blanks become one space, which
the tokenizer's own normaliser does as well), digested, and joined together
with the digest of the tokenizer to a table of stored counts. Only distinct
contents that the table lacks are encoded; their counts are appended to it.

The tokenizer never lets a token cross a blank, so the count of a text is the
sum over its blank-separated words, and a bounded memo of words spares most of
the encoding.

Null text: empty, 0 tokens. Empty table: no rows, nothing is appended. Repeated
rows and equal texts: encoded once, one row returned for each input row. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import afresh, as_bytes, scratch_path, text_or_empty, to_python

#: Words held by one Python worker's memo; it starts anew when full.
MEMO_WORDS = 300_000
CACHE = "tokenizer binary, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> bytes:
    """Names the tokenizer by its file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).digest()


class WordTokens:
    """Token counts by word, for one tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # bytes.split() cuts at exactly the six ASCII blanks
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        fresh = list({w for words in split for w in words if w not in memo})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            memo.update(zip(part, map(len, found)))
        return [sum(map(memo.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=2)
def _words(path: str, version: bytes) -> WordTokens:
    """One for each Python worker, which keeps its memo over many tasks."""
    return WordTokens(path)


def _encode(path: str, version: bytes):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(path, version)
        for batch in batches:
            texts, counts = as_bytes(batch.column("content")), []
            for i in range(0, len(texts), 500):
                counts += words.counts(texts[i : i + 500])
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.binary()), batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return run


def with_digest(docs: DataFrame) -> DataFrame:
    content = F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", " ")
    return docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), content.alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content"), 256)))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs. cache_path: the stored counts, kept and extended; a fresh table by default."""
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == F.lit(version)).select("digest", "n_tokens")

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    keyed = with_digest(docs)
    contents = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    misses = contents.join(stored(), "digest", "left_anti")
    to_python(misses.select("digest", "content")).mapInArrow(_encode(tokenizer_path, version), CACHE).write.mode("append").parquet(cache_path)
    # One count for each digest, even where two jobs appended the same one.
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.select(afresh().alias("known"), "n_tokens")
    return keyed.select("doc_id", "n_bytes", "digest").join(counts, F.col("digest") == F.col("known")).select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts of all documents, from an empty cache: null and empty texts have 0, repeated rows are each returned; no rows for an empty table."""
    import public_tokenizers

    from nearfold.llm.common import table

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
