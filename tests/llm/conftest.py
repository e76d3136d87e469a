import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, score double, fp string, taken int, label int, _key string, _doc long, _size int, _turn int, rep long, copy string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(i: int, n: int = 40) -> str:
    """Words that differ from text to text but repeat from run to run."""
    return " ".join(WORDS[(i * 7 + j * j * (i + 3) + j) % len(WORDS)] + ("" if j % 5 else str((i * 31 + j) % 17)) for j in range(n)) + "."


def rows() -> list[tuple]:
    """Nulls in every column, empty, wordless and very long texts, ties, copies and repeated rows."""
    texts = {0: sentence(0), 1: sentence(1), 2: sentence(0), 3: None, 4: "", 5: " \t\n", 6: sentence(6, 30_000), 7: "x", 8: "Ünïcödé ▁ 日本 \U0001f600", 9: sentence(9), 10: sentence(10)}
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i != 9 else None, len(t or ""), 5, "k", 1, 0.5, "f", 2, 1, "u", 1, 1, 1, 1, "c") for i, t in texts.items()]
    out.append(out[1])  # a repeated row
    out.append((None, sentence(1), *[None] * 16))
    out.append((1, "another text of document one", "fr", "s0", 28, 1, "k", 1, 0.1, "f", 1, 0, "u", 1, 1, 1, 1, "c"))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and columns whose names operators use themselves."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
