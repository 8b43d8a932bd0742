"""Small tables with the cases that the operators must define: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a to in is was that for on as with his they be at one have this der die und ein le la et les el los y de".split()


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(WORDS) * rng.randint(0, 1) for _ in range(k))
    passage = prose(70)
    out = []
    for i in range(n):
        text = prose(rng.choice([1, 3, 8, 40, 120, 300]))
        if i % 9 == 0:
            text = f"{prose(6)} {passage} {prose(5)}"
        if i % 13 == 1 and out:
            text = out[rng.randrange(len(out))][1]
        if i % 11 == 2 and out and out[-3:][0][1]:
            words = out[-3:][0][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i == n // 2:
            text = prose(6000)
        out.append((i, text, rng.choice(["en", "de", "fr"]), f"s{0 if i % 3 else i % 7}", len(text or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n ", "en", "s1", 4), (n + 3, "éß日本語😀 " * 30, None, "s2", None), (n + 4, "ab" * 400, "en", None, 800)]
    return out


def docs(spark, seed: int = 1, n: int = 120):
    return spark.createDataFrame(rows(seed, n), COLUMNS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(spark, *names: str):
    from pyspark.sql import functions as F

    df = docs(spark)
    return df.withColumns({x: F.lit(1) for x in names})


def by_id(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}
