import pytest

TEXTS = [
    (1, "Hello world, this is a clean little text about nothing much at all."),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b "),
    (5, "x" * 30_000),
    (6, "word " * 20_000),
    (7, "Same text twice here\nSame text twice here\nand once more"),
    (7, "Same text twice here\nSame text twice here\nand once more"),
    (None, "no id at all, mail me: a.b@c.example.org"),
    (9, "ünïcödé 中文 😀   　 ▁   é́ ﬁ"),
    (10, "\n\n\n"),
    (-11, "negative id"),
]
ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, _gone long, a string, component_id int, size double, target string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", [None, "a", "b"][k % 3], None if t is None else len(t), "x", 1, "y", 2, 0.5, "z") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def small(spark):
    """The generated tables at the smallest scale: (folder, [(doc_id, text)])."""
    folder = "/root/testdata/sf0.001"
    try:
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    except Exception:
        pytest.skip("the generated tables are not here")
    return folder, [(r[0], r[1]) for r in rows]
