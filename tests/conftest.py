import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest  # noqa: E402

from vellumite.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", master="local[2]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
