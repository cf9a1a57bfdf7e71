import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..", "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    prose = " ".join(f"word{i * 7919 % 613} and then some" for i in range(120))
    rows = [
        (1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + " more", "en", "a", None), (3, "", "en", None, 0),
        (4, None, None, None, None), (None, "one two three", "fr", "b", 13), (None, None, None, None, None),
        (5, " \n\t ", "en", "b", 4), (6, "x" * 300_000, "de", "b", 300_000), (7, "same words here", "en", "c", 15),
        (8, "same words here", "en", "c", 15), (9, "Ça va? été 中文 " * 3, "fr", "c", 5), (10, "1 2 3 !!!", "en", "c", 9),
        (11, (prose + " ") * 20, "en", "c", 5),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "score double, shard int, slot int, length int, hash long, pos int, label int, cls long, h long, n long, spans string"
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"{names}, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
