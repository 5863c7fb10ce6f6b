import pytest

from plait.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
