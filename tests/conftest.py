import shutil
import tempfile

import pytest

from tessellar.session import get_session


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="tessellar-test-")
    s = get_session("tests", 4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
