import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from quadloom.session import get_spark  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("quadloom-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def small_data_settings(request, spark):
    """Hand-made inputs are tiny: compiling their plans would take most of the time.  The
    registered queries keep compiled plans, as in use."""
    compiled = request.module.__name__.endswith("test_oracle")
    spark.conf.set("spark.sql.codegen.wholeStage", str(compiled).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "8" if compiled else "3")
    yield


@pytest.fixture(scope="session")
def sf():
    return SF
