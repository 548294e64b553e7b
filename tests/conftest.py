import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").appName("rankflow-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from rankflow import schemas

    return spark.createDataFrame([
        ("a", "Alpha", ["One"], "First", "1999-05-01", ["rock", "loud"]),
        ("b", "Beta", ["Two", "Three"], "Second", "2001-01-01", ["pop"]),
        ("c", "Gamma", ["one"], "Third", None, []),
        ("d", "Delta", [], "Fourth", "2010", ["jazz", "calm", "late", "night", "sax", "slow", "blue"]),
        ("e", "Epsilon", ["Five"], None, "1988", None),
    ], schemas.CATALOG)


@pytest.fixture(scope="session")
def turns(spark):
    return spark.createDataFrame([
        ("s1", 1, 0, "user", "play rock"), ("s1", 1, 1, "music", " a "), ("s1", 1, 2, "assistant", "here you go"),
        ("s1", 2, 0, "user", "more pop"), ("s1", 2, 1, "music", "x"), ("s1", 2, 2, "music", "b"),
        ("s1", 3, 0, "user", "something calm"),
        ("s2", 1, 0, "system", "start"), ("s2", 1, 1, "user", "hello there"),
    ], "session_id string, turn_number int, pos int, role string, content string")


def rows(df, *names):
    """Sorted tuples of a DataFrame."""
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
