import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hopscore.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 2, **{"spark.ui.showConsoleProgress": "false"})


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on Python values: ``value(fn, "type", x)``."""

    def evaluate(function, dtype: str, item):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(item,)], f"x {dtype}").select(function(F.col("x")).alias("y")).first()[0]

    return evaluate


@pytest.fixture
def make_results(spark):
    """Results from ``(id, gen, exec, eval)`` tuples of one configuration, or with the configuration after the id."""
    from hopscore.model import RESULTS

    def make(*rows, config=("llm", "cypher", "m1")):
        return spark.createDataFrame([(r[0], *config, *r[1:]) if len(r) == 4 else r for r in rows], RESULTS)

    return make


@pytest.fixture
def make_questions(spark):
    from hopscore.model import QUESTIONS

    def make(*rows):
        return spark.createDataFrame([(i, f"question {i}", answer, extra) for i, answer, extra in rows], QUESTIONS)

    return make
