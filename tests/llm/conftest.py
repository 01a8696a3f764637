import pytest
from llm_paths import SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, and
    further columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (None, base, None, None),
        (3, base + " phi", "en", "b"), (4, "", "en", "b"), (5, None, "de", "b"), (6, " \t\n ", None, None),
        (7, "two words", "en", "c"), (8, "two words", "de", "c"), (9, long, "en", None), (10, long + " end", "fr", "a"),
        (None, None, None, None), (11, "12345 !!! ???", "en", "a"), (12, base.upper(), "en", "a"),
        (13, "x" * 5000, "en", "b"), (14, "a  b c\x1cd \n e", "es", "c"), (-5, base, "en", "c"),
    ]
    clash = ("_id", "_t", "_row", "_doc", "kept", "score", "copies", "lang_pred", "chunk", "u", "size", "_pid", "_key", "key")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), *[f"{c}{i}" for c in clash]) for i, r in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)

