"""Each query of the catalog against its SQL."""

import pytest

from tests.oracle import same
from turnwise.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_two_edits_reach_further(spark):
    from turnwise.operators import spelling

    model = spark.createDataFrame([("letter", 9), ("better", 3), ("ab", 5)], "word string, n long")
    words = spark.createDataFrame([("letter",), ("lettr",), ("eltter",), ("lxttxr",), ("zzzzzz",), ("don't",), ("ba",), ("btetre",)], "word string")
    got = dict(spelling.corrections(words, model).collect())
    assert got == {"letter": "letter", "lettr": "letter", "eltter": "letter", "lxttxr": "letter", "zzzzzz": "zzzzzz", "don't": "don't", "ba": "ab", "btetre": "better"}
