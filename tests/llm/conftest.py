import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, old string, copies long, new_shard string, _key string, l_id long, t string"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(chr(97 + (r.randrange(vocabulary) * 7 + k * k) % 26) for k in range(3 + r.randrange(6))) for _ in range(n))


def rows(texts, start=0):
    """Documents with extra columns whose names operators use inside."""
    return [(start + i, t, "en", f"src{i % 3}", len(t or ""), "x", "y", "z", 7, "k", "q", 1, "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda r: spark.createDataFrame(r, SCHEMA)


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty and very long texts, repeated rows and ties."""
    long = words(5, 40_000)
    same = (100, words(6, 80), "en", "src0", 1, "x", "y", "z", 7, "k", "q", 1, "t")
    null = (None,) * 13
    return frame([null, null, (1, None, None, None, None) + (None,) * 8, (2, "", "en", "", 0) + (None,) * 8, (3, " \n .", "en", "src1", 4) + (None,) * 8, (4, long, "en", "src1", len(long)) + (None,) * 8, (None, words(6, 80), "en", None, 1) + (None,) * 8, same, same])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
