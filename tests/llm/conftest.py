import os

import pytest


@pytest.fixture(scope="module", autouse=True)
def shared_folder(tmp_path_factory, spark):
    """Written tables of these tests go to one folder of their own, if the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))


@pytest.fixture(scope="module")
def messy(spark):
    """Documents with nulls, empty and repeated texts, ties and columns that clash with those of the operators."""
    rows = [
        (1, "Hello world, this is a text. " * 3, "en", 5), (2, None, "en", 6), (3, "", None, 7), (4, " \n\t", "fr", 8), (None, "no id here at all", "en", 9),
        (5, "same text twice", "en", 1), (5, "same text twice", "en", 1), (6, "x", "fr", 2), (7, "naïve été 漢字 🙂 \u0000 ▁", None, 3), (8, "long " * 40_000, "en", 4),
    ]
    columns = "doc_id long, text string, lang string, n long"
    df = spark.createDataFrame(rows, columns)
    return df.selectExpr("*", "'a' AS key", "'b' AS token", "'c' AS cls", "'d' AS kind", "1 AS score", "2 AS start", "3 AS grp", "'e' AS n_tokens", "'f' AS comp")
