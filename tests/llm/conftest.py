import pytest


@pytest.fixture(scope="session")
def scratch(spark):
    from signal_engine.llm.common import Scratch

    return lambda name: Scratch(spark, name)
