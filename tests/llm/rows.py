"""A small documents table with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with ours."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, node string, Score string, Spans string, IDS string, Mix_Rate string, copies string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(50))]) for _ in range(n))


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def documents(spark, extra=()):
    rng = random.Random(11)
    base = [prose(rng, n) for n in (120, 200, 80)]
    texts = [*base, *[near(rng, b, e) for b in base for e in (1, 1, 2, 3, 8, 20)], base[0], base[0], "", "", " ", None, None, "one two", "one two", "three", prose(rng, 9000), "é 你好 \x00 😀 ▁ \n\t", *[prose(rng, 60) for _ in range(20)], *extra]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None if t is None else len(t), *["x"] * 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[25], (None, "nobody's text", None, None, None, *["x"] * 7), (None, None, None, None, None, *["x"] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
