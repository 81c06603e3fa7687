"""A small corpus with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and odd columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, kind string, block string, rid string"


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "And", "of", "étaient", "über", "señor", "q", "Alpha", "beta,", "gamma.", "x1", "日本", "ß"] + [f"w{i}" for i in range(200)]

    def prose(k: int) -> str:
        return " ".join(rng.choice(words) for _ in range(k))

    passage = prose(70)
    base = [prose(rng.choice([1, 3, 4, 30, 80, 200])) for _ in range(n)]
    texts: list[str | None] = list(base)
    texts += base[:8]  # exact copies
    for text in base[8:20]:  # near copies
        own = text.split()
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [f"{prose(10)} {passage} {prose(10)}" for _ in range(6)]
    texts += [f"{prose(5)}\n{passage}", passage, passage + " " + passage]
    texts += [None, "", " \t\n", "123 456 !!", "a" * 900, "ab" * 700, prose(9000), "naïve\x0b\x0cfoo\x00bar \u00a0 baz", "<|endoftext|> token"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None]), len(t or ""), "1", "2", "3", "4", "5") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
