import pytest

from rekindle.operators import assemble
from rekindle.sources import readers, writers


def test_first_source_wins_on_shared_columns(spark):
    events = spark.createDataFrame([(1, 101), (2, 202)], "user_id int, item_id int")
    users = spark.createDataFrame([(1, "BD"), (2, "US")], "user_id int, country string")
    items = spark.createDataFrame([(101, "Warehouse-BD", "Books"), (202, "Warehouse-US", "Games")],
                                  "item_id int, country string, category string")
    out = assemble.assemble_interactions(
        [("public.events", events, {}), ("public.users", users, {}), ("public.items", items, {})],
        ["user_id", "item_id"], ["user_id", "item_id", "country", "category"],
    )
    assert out.columns == ["userID", "itemID", "country", "category"]
    assert sorted(map(tuple, out.collect())) == [("1", "101", "BD", "Books"), ("2", "202", "US", "Games")]


def test_null_keys_match(spark):
    a = spark.createDataFrame([("1", "x"), (None, "y")], "k string, a string")
    b = spark.createDataFrame([("2", "p"), (None, "q")], "k string, b string")
    out = {tuple(r) for r in assemble.outer_merge(a, b, ["k"]).collect()}
    assert out == {("1", "x", None), ("2", None, "p"), (None, "y", "q")}


def test_no_common_key(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    with pytest.raises(ValueError, match="no merge key"):
        assemble.outer_merge(a, b, ["k"])


def test_names_are_separated(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, v int, b_v int")
    b = spark.createDataFrame([(1, 4)], "k int, v int")
    layout = assemble.Layout([("A-1", a.columns), ("b", b.columns)], ["k"], ["v"])
    assert layout.renamed(0, a).columns == ["k", "a_1_v", "b_v"] and layout.renamed(1, b).columns == ["k", "b_v_2"]
    assert layout.of[1]["v"] == "b_v_2" and layout.copies["v"] == ["a_1_v", "b_v_2"]


@pytest.mark.parametrize("left,right,name", [("userID", "x", "userID"), ("x", "itemID", "itemID"), ("id", "user_id", "user_id"),
                                             ("actor_ref", "ref", "actor_ref"), ("ab", "abc", "abc"), ("Key", "key", "Key")])
def test_join_names(left, right, name):
    assert assemble.join_name(left, right) == name


def test_raw_sql(spark):
    rows = [(1, 101, 1, "Alpha"), (2, 202, 1, "Beta"), (2, 202, 1, "Beta")]
    spark.createDataFrame(rows, "user_id int, item_id int, interaction_value int, service_name string").createOrReplaceTempView("raw_rows")
    out = assemble.raw_sql_dataset(spark, "select * from raw_rows where user_id >= :least", least=1)
    assert out.count() == 2 and out.columns == ["user_id", "item_id", "interaction_value", "service_name"]
    with pytest.raises(ValueError, match="item_id"):
        assemble.raw_sql_dataset(spark, "select user_id from raw_rows")


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc"), (2, None)], "x int, y string")
    files = writers.write_dataset(df, str(tmp_path / "out"))
    assert sorted(r["x"] for r in readers.read_file(spark, files["csv"]).collect()) == [1, 2]
    back = readers.read_file(spark, files["json"], "jsonl", schema="x int, y string")
    assert {tuple(r) for r in back.collect()} == {(1, "a,\"b\"\nc"), (2, None)}
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("array.json", "lines.jsonl"):
        assert readers.read_file(spark, str(tmp_path / name)).count() == 2
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.json").write_text('{"a":\n 1}')
    (mixed / "b.json").write_text('[{"a": 2}, {"a": 3}]')
    assert sorted(r.a for r in readers.read_file(spark, str(mixed), "json").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        readers.file_format("x.xlsx")
    again = readers.read_source(spark, "json", {"path": files["json"]}, "x = 2")
    assert again.count() == 1


def test_json_output_holds_finite_numbers_only(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, nan, -inf, "NaN"), (2, 0.5, 2.0, None), (3, None, inf, "a")]
    df = spark.createDataFrame(rows, "id int, `x.y` double, z float, t string")
    files = writers.write_dataset(df, str(tmp_path / "out"))
    back = sorted(tuple(r) for r in spark.read.schema(df.schema).json(files["json"]).collect())
    assert back == [(1, None, None, "NaN"), (2, 0.5, 2.0, None), (3, None, None, "a")]
