"""Small tables with what real ones hold: nulls, empty and very long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, c string, n string, key string, token string, gone string, row string"


def documents(seed=0, n=60, words=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, words))) for _ in range(n)]
    passage = " ".join(rng.choice(pool) for _ in range(60))
    texts += [t + " " + passage for t in texts[:10]]
    texts += texts[:8]
    near = [rng.choice(pool) for _ in range(50)]
    for k in range(25):
        copy = list(near)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(50)] = rng.choice(pool)
        texts.append(" ".join(copy))
    texts += [None, "", "  \n\t ", "one", "One", "a b c", "!!! ...", "\n".join(["same line of words here"] * 5 + ["", "other"]), " ".join(rng.choice(pool) for _ in range(30_000))]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None][i * i % 3], None, "x", 1, "y", "z", "k", "t", "g", "r") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1]]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
