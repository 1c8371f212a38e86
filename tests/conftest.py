import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from heatloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                            spark__ui__showConsoleProgress="false", spark__checkpoint__dir=folder,
                            spark__sql__warehouse__dir=folder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
