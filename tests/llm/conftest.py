import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tidemark.plans.ship import ship_package

    ship_package(spark)
