import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import session

    s = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('scratch')}",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="3g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
