import random

import pytest

WORDS = "the of and to in a is that river stone light cloud garden window letter music paper silver morning".split()

#: Columns whose names the operators use themselves.
CLASH = "rank string, doc string, n long, size long, word string, key string, digest string, taken string, removed string, fp long, spans string, copies string, lines string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, "r", "d", 7, -1, "w", "k", "g", "t", "x", 3, "s", "c", "l")


def prose(seed, lines=6, words=12):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(words)) for _ in range(lines))


def corpus():
    rows = [row(i, prose(i), source="abc"[i % 3]) for i in range(1, 41)]
    rows += [row(100 + i, prose(1)) for i in range(4)]  # exact copies
    rows += [row(110 + i, prose(2).replace("the", f"word{i}", 1)) for i in range(3)]  # near copies
    rows += [row(120, prose(3) + "\n" + prose(60)), row(121, prose(61, 3) + "\n" + prose(4))]  # shared lines
    rows += [row(130, None), row(131, ""), row(132, " \n\t "), row(133, None, None, None), row(None, prose(5)), row(None, None, None, None)]
    rows += [row(7, prose(7), source="b"), row(7, prose(7), source="b"), row(8, prose(62))]  # repeated rows; one id twice
    rows += [row(140, "One"), row(141, "l'été œuvre 日本 ́x  ▁ <|endoftext|> <s>"), row(142, "x" * 3000), row(143, prose(63, 400, 30))]
    rows += [row(150 + i, "same words again and again " * 12) for i in range(2)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in corpus()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
