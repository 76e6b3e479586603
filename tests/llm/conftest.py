import random

import pytest

from docweave.llm.work import Workspace

SCHEMA = "doc_id long, text string, source string, lang string, n_tokens string, score string, row string, copies string, part string, kept string"


def invented(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, repeated rows, equal texts, near copies, odd characters, clashing columns."""
    base = invented(1, 200)
    words = base.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [
        (1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (None, base), (None, None), (None, invented(9, 30)),
        (7, "Only four words here"), (8, "only FOUR words here"), (9, "Ünïcode ÉÀ ß 日本語  x\x1cy <|endoftext|> it's 1²3"), (10, " \n\t\r\x0b\x0c "),
        (11, invented(2, 30000)), (12, invented(3, 60) + "\n" + invented(4, 60)), (13, "a" * 5000), (14, "line\n" * 50),
    ]
    return [(i, t, None if n == 5 else f"s{n % 4}", "en", "x", "x", "x", "x", "x", "x") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")
