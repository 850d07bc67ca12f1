import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, chunk long, id string, fp long"


def prose(seed: int, n: int) -> str:
    """n words from a fixed rule."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfglmnprst"[(x >> s) % 12] + "aeiou"[(x >> s) % 5] for s in range(4, 4 + 3 * (2 + x % 3), 3)))
    return " ".join(out)


def edge_texts() -> list:
    shared, line = prose(1, 60), "All of this is repeated, again and again, in many documents of the table.\n"
    return [
        None, "", " \t\n ", "one", "Ünïcödé wörds — und “quotes” 漢字 😀", shared, shared, shared.upper(),
        prose(2, 30) + " " + shared + " " + prose(3, 30), prose(4, 10) + "\n" + shared + "\n" + prose(5, 80),
        line * 12, "a" * 5000, "word " * 2000, prose(6, 9000), prose(6, 9000) + " end", prose(7, 3) + " " + shared[:200],
        "#*$%&|<> " * 40, "\x00\x1f control \x7f" * 5,
    ]


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with ids, the last two of them equal, and one null id."""
    texts = edge_texts()
    rows = [(i * 3 + 1, t, "en" if i % 2 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(9, 50), None, None, 1)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in edge_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.unionByName(docs.where(F.col("doc_id") % 9 == 0).withColumn("doc_id", F.col("doc_id") + 100_000)).cache()


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.collect()]
