import pytest

from tabsmith.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tabsmith-tests", "8g")
    # the tables are tiny: compiling stages and spreading them would be most of the time
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    return session


@pytest.fixture
def frame(spark):
    """One-column or several-column table from Python lists: frame('c int', [1, 2])."""

    def make(schema, *columns):
        return spark.createDataFrame(list(zip(*columns)), schema)

    return make
