"""Small inputs with what operators must bear: nulls, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, row int, label string"


def words(generator, n):
    return " ".join("".join(generator.choice("abcdefgh") for _ in range(generator.randint(2, 7))) for _ in range(n))


def rows():
    g = random.Random(5)
    base = words(g, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.replace(" ", "\n"), "", None, " \t\n", "one", "two words", "a b c d e",
        words(g, 30_000), "é ü 日本  x y \x1c z", "x" * 20_000, base + " tail", "a b c d e",
    ]
    made = [(i, t, "en" if i % 3 else None, [None, "s1", "s2", "é"][i % 4], None if i % 5 == 0 else 7, "clash", None, i, "z") for i, t in enumerate(texts)]
    made.append(made[0])
    made.append((None, base, None, None, None, None, None, None, None))
    made.append((None, None, None, None, None, None, None, None, None))
    return made


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
