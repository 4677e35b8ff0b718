import uuid

import pytest

from ledgerfold import Database

PREFIX = "018f0f8e-7b6d-7c4a-8f12-"


def uid(suffix: str) -> str:
    return f"CAST('{PREFIX}{suffix}' AS UUID)"


def key(suffix: str) -> uuid.UUID:
    return uuid.UUID(PREFIX + suffix)


@pytest.fixture
def db(spark):
    database = Database.in_memory(spark)
    yield database
    database.close()


@pytest.fixture
def wide(spark):
    database = Database.in_memory(spark, profile="extended")
    yield database
    database.close()
