import random

import duckdb
import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("part", T.StringType()), ("key", T.LongType()), ("fg_slot", T.StringType()))])


def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds, columns named like the operators' own."""
    r = random.Random(4)
    names = ["the", "of", "alpha", "béta", "Gamma", "x'll", "漢字", "١٢", " ", "á", "😀", "token=abcdefgh12", "<|im_end|>"]
    say = lambda n: "".join(r.choice(names) + r.choice([" ", "  ", "\n", "\t", " \r\n", "\x0b"]) for _ in range(n))
    shared = say(40)
    long = say(30_000)
    texts = [None, "", " ", "\n\n", "one", shared, shared.replace("  ", " "), say(5) + shared, shared + say(30), say(20), say(13), say(12), long, long[: len(long) // 2], say(60) * 3]
    rows = [(i, t, r.choice(["en", "de", None, "xx"]), r.choice(["src0", "src1", "other", None]), None, "p", 7, "s") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "different text under an id that is taken", "en", "src0", 1, "p", 7, "s")]
    rows += [(None, shared, "en", "src0", 1, None, None, None), (None, None, None, None, None, None, None, None), (100, shared, "fr", "src0", 2, "p", 7, "s")]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain_docs(spark):
    """The hard rows with ids of their own, as the contracts have them."""
    rows = [(i, *row[1:]) for i, row in enumerate(hard_rows())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def folder(plain_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    plain_docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="session")
def duck(folder):
    """Rows of DuckDB SQL over the folder's documents, columns in order of their names."""

    def run(sql):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(tuple(row[i] for i in order) for row in got.fetchall())

    return run


def by_name(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
