"""Documents that operators must get through: nulls, blanks, long texts, repeats, clashing columns."""

import random

LONG = " ".join(f"Word{i % 997} and the {i}." for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, _row string, Shard int, h string"


def odd_rows():
    base = " ".join(f"alpha{i} beta gamma" for i in range(40))
    texts = [None, "", " \n\t ", "one", "one two three", base, base, base + " more", "##*$%&|<>\n##*$%&|<>\n\n \nend", "é" * 300, "<|endoftext|> x <|endoftext|>", "\x1c\x85  a", LONG]
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", "y", 3, "z") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def random_text(rnd: random.Random, words: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(words))
