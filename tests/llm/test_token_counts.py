import public_tokenizers
from tokenizers import Tokenizer

from nearfold.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in texts)


def test_counts_equal_the_library(docs, texts):
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts(docs, PATH).collect()) == expected(texts)


def test_the_cache_is_used_and_extended(spark, docs, no_docs, texts, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = docs.where("doc_id < 20")
    token_counts(first, PATH, cache).collect()
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == first.select("text").distinct().count()
    assert token_counts(no_docs, PATH, cache).count() == 0 and spark.read.parquet(cache).count() == n
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts(docs, PATH, cache).collect()) == expected(texts)
    assert spark.read.parquet(cache).count() > n
    again = spark.read.parquet(cache).count()
    token_counts(docs, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == again


def test_special_strings_inside_words(spark):
    t = ["a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|> y", "O'Neil's can't", "ΑΣ ΟΔΟΣ", "a b c", "12 345 6.7"]
    rows = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts(rows, PATH).collect()) == expected(list(enumerate(t)))
