import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

VOCABULARY = "the of and to in a is that for it was on with he be at by had this as".split()

#: The columns of documents, and others with names that operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[
            T.StructField(n, T.StringType())
            for n in "id row digest words ids grp n_words line gram part role signature one component kept removed_words".split()
        ],
    ]
)


def prose(seed, n, first=0):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(VOCABULARY)}{rng.randint(first, first + 400)}" for _ in range(n))


def document(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), *["x"] * 16)


def messy_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    passage, base = prose(1, 70), prose(2, 300)
    near = base.split()
    rows = [
        document(1, None),
        document(2, ""),
        document(3, " \n\t\x0b "),
        document(4, "short text"),
        document(None, prose(3, 80)),
        document(5, base),
        document(6, base),
        document(7, " ".join([*near[:150], "changed", *near[151:]])),
        document(8, " ".join([*near[:40], "other", *near[41:], "tail"]), None, None),
        document(9, base.upper()),
        document(10, f"{prose(4, 60)}\n{passage}\n{prose(5, 60)}", source=None),
        document(11, f"{prose(6, 60)} {passage} {prose(7, 60)}", lang=None),
        document(12, prose(8, 4000, 1000)),
        document(13, "x" * 30000),
        document(14, "one two three " * 60),
        document(15, f"{passage} {passage}"),
        document(16, "Ünï Straße — “quoted” 中文 😀 " * 20),
    ]
    rows += [document(20 + k, f"{prose(20 + k, 120)}\nShared line number {k} of the site\n{prose(50 + k, 30)}", source="host") for k in range(12)]
    rows += [document(40 + k, "\n".join(["Menu one two  THREE", *[prose(300 + j, 9) for j in range(12)], prose(80 + k, 10)]), source="host2") for k in range(8)]
    return [*rows, rows[5], rows[10]]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
