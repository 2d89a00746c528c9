import pytest

from tests.oracle import make_spark


@pytest.fixture(scope="session")
def spark():
    session = make_spark("4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
