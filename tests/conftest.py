import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keystride.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("keystride-tests", "local[8]", 2)
    s.conf.set("spark.keystride.oneTaskBytes", "0")  # every table is dealt to range partitions
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling costs more than running
    yield s
    s.stop()


@pytest.fixture
def sized(spark):
    """Tables that one task may hold are not dealt, as outside of tests."""
    spark.conf.unset("spark.keystride.oneTaskBytes")
    yield spark
    spark.conf.set("spark.keystride.oneTaskBytes", "0")
