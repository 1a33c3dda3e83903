"""Documents with every case that operators must take, and brute-force pieces."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("part", T.StringType())])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def frame(spark, rows, partitions=3):
    """(doc_id, text) pairs with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "r", "s", None, "p") for i, t in rows], SCHEMA).repartition(partitions)


def sample(seed=0, n=60):
    """Texts with copies, near copies, shared passages, blanks, nulls, odd characters and one long text."""
    import random

    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = text(90)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            rows.append(text(rng.randint(1, 260)))
        elif kind == 1:
            rows.append(rng.choice(rows))
        elif kind == 2:
            w = (rng.choice(rows) or "x").split(" ")
            w[rng.randrange(len(w))] = "Edited"
            rows.append(" ".join(w))
        elif kind == 3:
            rows.append(text(rng.randint(1, 60)) + "\n" + passage + " " + text(rng.randint(1, 60)))
        elif kind == 4:
            rows.append((rng.choice(rows) or "").upper().replace(" ", "\t ", 3))
        else:
            rows.append(text(rng.randint(1, 12)))
    rows += [None, "", "", " \t\n", "é ñ 漢字 🎉 x", "a", "a", "A", "a b", "b a", text(9000), "\x00 nul", "x" * 3000]
    return list(enumerate(rows))
