import pytest

from weftline.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", 4)
    made.sparkContext.setLogLevel("ERROR")
    return made
