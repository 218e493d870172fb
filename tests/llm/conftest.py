import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The working folder that a cluster would name, unless the session has one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, repeated rows, a long text, a null id, and columns named like those of the operators."""
    rows = [
        (1, None, "a", 0, 0),
        (2, "", "a", 0, 0),
        (3, "alpha beta gamma delta epsilon zeta eta theta", "a", 0, 0),
        (3, "alpha beta gamma delta epsilon zeta eta theta", "a", 0, 0),
        (4, "alpha beta gamma delta epsilon zeta eta theta", None, 0, 0),
        (None, "short text", "b", 0, 0),
        (5, " \n\t", "b", 0, 0),
        (6, "word " * 30000 + "end", "b", 0, 0),
        (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" éx', "c", 0, 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, key int")
