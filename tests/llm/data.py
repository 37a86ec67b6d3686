"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators give to their own columns.
CLASHES = ["size", "row", "block", "rank", "copies", "class", "component", "shard", "slot", "key", "found", "spans", "segment", "score", "run", "ahead"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=5):
    """Documents with nulls in every column, near and exact copies, an empty, a blank and a very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append([i, words(rng, rng.randrange(1, 90)), rng.choice(["en", "de"]), f"s{i % 4}"])
    base = words(rng, 80).split()
    for i in range(60, 72):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append([i, " ".join(copy), "en", "hot"])
    rows += [[72, None, None, None], [73, "", "en", None], [74, " \t\n", "fr", "s1"], [75, words(rng, 30_000, 5_000), "en", "s2"], [76, "Z" * 70_000, "en", "s2"]]
    rows += [list(rows[3]), list(rows[3]), [None, "no id at all here", "en", "s0"], [None, rows[5][1], None, "s3"]]
    rows += [[None, " ".join(base[:-1] + ["nobody"]), "en", "s3"]]
    rows += [[77, "ünïcødé \U0001d538 words in here, and more of them", "de", "s1"], [78, "tail words", "en", "s1"]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def odd_docs(spark, rows=None):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    for name in CLASHES:
        df = df.selectExpr("*", f"'{name}' AS {name}")
    return df.repartition(4)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
