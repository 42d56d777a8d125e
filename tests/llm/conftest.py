import random
import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, uid string, n_words string, taken string, class_uid string, k1 string, __text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and ids, and near copies."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), prose(2, 60), None, "", " \n\t ", "one", prose(3, 30_000), "x" * 200_000, "it's 4111111111111111 and a.b@c.org, +1 (555) 123-4567", (prose(4, 9) + " ") * 20]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[0], (0, prose(5, 25), "de", None, 1), (None, prose(6, 40), None, None, None), (None, None, None, None, None), (2**60 + 1, prose(7, 45), "en", "s1", 1)]
    return [(*r, "s", "u", "n", "t", "c", "k", "x") for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir(spark):
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no driver tables")
    return path


def crc(x: bytes) -> int:
    return zlib.crc32(x)
