import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lintlake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # small inputs: compiling generated code and recording call sites would take most of the time
    session = build_session("local[8]", shuffle_partitions=4, spark__sql__codegen__wholeStage="false",
                            spark__sql__codegen__factoryMode="NO_CODEGEN",
                            spark__python__sql__dataFrameDebugging__enabled="false",
                            spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def corpus(spark):
    """Files from {path: text}."""
    def make(files: dict[str, str]):
        return spark.createDataFrame(list(files.items()), "file_path string, content string")
    return make


@pytest.fixture
def compiled(spark):
    """Code generation as in production."""
    names = "spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode"
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("true", "FALLBACK")):
        spark.conf.set(name, value)
    yield spark
    for name, value in zip(names, before):
        spark.conf.set(name, value)
