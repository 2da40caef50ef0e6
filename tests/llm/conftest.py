import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__hash` string, size int, cid int, slice int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts, languages and sources; empty, blank and very long texts; repeated rows; clashing names."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    texts = [None, "", " \n\t ", "x", line, line * 300, line, line + "phi chi psi omega", "é😀 " * 50, "password: hunter22 " + "ab12" * 8]
    rows = [(i if i % 4 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "h", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (7, "another text under a used id", "en", "s1", 1, "h", 1, 2, 3), (None, line, None, None, 1, "h", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
