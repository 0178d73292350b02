import pytest

from ebbline.llm.common import ship_package

#: Nulls, empty texts, white space, one word, repeated rows, equal texts, a null id, other scripts.
ODD = [
    (1, "The cat sat on the mat and then it ran away from the old dog in the yard", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (4, "  \n\n ", "en", "s"),
    (5, "word", "en", "s"),
    (6, "The cat sat on the mat and then it ran away from the old dog in the yard", "en", "s"),
    (6, "The cat sat on the mat and then it ran away from the old dog in the yard", "en", "s"),
    (None, "The cat sat on the mat and then it ran away from the old dog in the yard", "en", "s"),
    (7, "été où ça ▁ 漢字 😀 \t x\u0001y", "fr", "s"),
    (8, "123 456 !!", "en", "s"),
    (9, "lorem ipsum dolor " * 4000, "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(shipped):
    return shipped.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(shipped):
    return shipped.createDataFrame([], SCHEMA)
