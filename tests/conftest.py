import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgertone.session import get_session

    session = get_session(
        "tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("ckpt")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
