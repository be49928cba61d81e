import pytest

from rekindle.functions.scalars import join_key, name_tokens
from rekindle.operators import clean
from rekindle.operators.clean import Roles, k_core, standardise
from rekindle.operators.roles import column_facts, detect_roles, mapping_warnings, standardise_columns
from rekindle.operators.split import check_splittable, drop_cold_users, hash_split
from pyspark.sql import functions as F


@pytest.mark.parametrize("raw,key", [
    ("1", "1"), ("1.0", "1"), (" 1 ", "1"), ("001", "1"), ("1e3", "1000"), ("-0", "0"), ("-2.50", "-2.5"),
    ("1e-5", "1e-05"), ("1234567.5", "1.23457e+06"), ("nan", "nan"), ("inf", "inf"), ("0x10", "0x10"), ("1d", "1d"),
    ("", ""), (None, None), ("1e400", "1e400"), ("abc ", "abc"), ("16252.55", "16252.5"), ("0.1", "0.1"),
])
def test_join_key(spark, raw, key):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(join_key(F.col("v"))).first()[0] == key


def test_join_key_of_numbers(spark):
    df = spark.createDataFrame([(7, 7.0, 7.25)], "a int, b double, c double")
    assert tuple(df.select(*[join_key(F.col(c)) for c in "abc"]).first()) == ("7", "7", "7.25")


def test_name_tokens(spark):
    df = spark.createDataFrame([("userAccount_idUser",)], "v string")
    assert df.select(name_tokens(F.col("v"))).first()[0] == ["user", "account", "id"]


def test_standardise(spark):
    rows = [(1, 10, "5", "2026-01-01"), (1, 10, "3", "2026-01-03"), (1, 10, "4", "2026-01-02"),
            (None, 10, "4", "2026-01-02"), (2, 11, "bad", "2026-01-02")]
    df = spark.createDataFrame(rows, "u int, i int, r string, t string")
    out = {r["userID"]: r for r in standardise(df, Roles("u", "i", "r", "t")).collect()}
    assert set(out) == {"1", "2"}
    assert out["1"]["rating"] == 3.0 and out["2"]["rating"] == 0.0
    assert out["1"]["timestamp"] == 1767398400e6


def test_missing_rating_is_one(spark):
    df = spark.createDataFrame([(1, 2)], "u int, i int")
    assert standardise(df, Roles("u", "i")).first()["rating"] == 1.0


def brute_core(pairs, a, b):
    pairs, gone_u, gone_i = set(pairs), 0, 0
    while True:
        n = len(pairs)
        count = lambda k: {x: sum(p[k] == x for p in pairs) for x in {p[k] for p in pairs}}
        weak = {u for u, c in count(0).items() if c < a}
        pairs = {p for p in pairs if p[0] not in weak}
        poor = {i for i, c in count(1).items() if c < b}
        pairs = {p for p in pairs if p[1] not in poor}
        gone_u, gone_i = gone_u + len(weak), gone_i + len(poor)
        if len(pairs) == n:
            return pairs, gone_u, gone_i


def test_k_core_is_the_brute_force_one(spark, planted):
    df = planted[0]
    pairs = [(r["userID"], r["itemID"]) for r in df.collect()]
    want, gone_u, gone_i = brute_core(pairs, 15, 22)
    got = k_core(df, 15, 22)
    assert {(r["userID"], r["itemID"]) for r in got.df.collect()} == want
    assert (got.removed_users, got.removed_items) == (gone_u, gone_i)
    assert got.df.columns == df.columns


@pytest.mark.parametrize("least", [(2, 2), (3, 1), (1, 3), (4, 3), (50, 50)])
def test_k_core_of_many_rounds(spark, monkeypatch, least):
    """A chain that unravels from its end, ids that lose all their pairs, and a core: as by brute force, and the pairs are counted once a side."""
    chain = [(f"u{n}", f"i{n}") for n in range(12)] + [(f"u{n + 1}", f"i{n}") for n in range(11)]
    core = [(f"c{a}", f"d{b}") for a in range(5) for b in range(4)] + [("c0", "i3"), ("lone", "only"), ("lone2", "d0")]
    pairs = chain + core
    whole, counted = clean.materialise, []

    def written(df, *a):
        counted.append("count(1) AS _n" in df._jdf.queryExecution().analyzed().toString())
        return whole(df, *a)

    monkeypatch.setattr(clean, "materialise", written)
    got = k_core(spark.createDataFrame(pairs, "userID string, itemID string"), *least)
    want, gone_u, gone_i = brute_core(pairs, *least)
    rows = [(r["userID"], r["itemID"]) for r in got.df.collect()]
    assert sorted(rows) == sorted(want)
    assert (got.removed_users, got.removed_items) == (gone_u, gone_i)
    assert sum(counted) == 2
    assert (got.rows, got.users, got.items) == (len(want), len({u for u, _ in want}), len({i for _, i in want}))


def test_small_tables_cannot_be_split(spark):
    empty = spark.createDataFrame([], "userID string, itemID string, rating double")
    with pytest.raises(ValueError, match="no interactions remained after cleaning"):
        check_splittable(empty)


def test_split_is_a_partition(spark, planted):
    df = planted[0]
    parts = hash_split(df)
    assert parts.train.count() + parts.test.count() == df.count()
    again = hash_split(parts.train, salt="|validation")
    assert 0 < again.test.count() < parts.train.count() / 2
    warm = drop_cold_users(parts)
    known = {r[0] for r in warm.train.select("userID").collect()}
    assert {r[0] for r in warm.test.select("userID").collect()} <= known


def test_roles_of_generic_names(spark):
    df = spark.createDataFrame(
        [(1, 10, 5, "2026-01-01"), (1, 11, 3, "2026-01-02"), (2, 10, 4, "2026-01-03")],
        "actor_ref int, object_ref int, score_value int, updated_at string",
    )
    # without a hint for the actor the second-chance scoring must find both ids
    out = standardise_columns(df)
    assert set(out.columns) == {"userID", "itemID", "rating", "timestamp"} and out.count() == 3


def test_not_training_ready(spark):
    df = spark.createDataFrame([(1001, 4, "2026-01-01"), (1002, 5, "2026-01-02"), (1003, 3, "2026-01-03")],
                               "id int, rating int, updated_at string")
    with pytest.raises(ValueError, match="not training-ready"):
        standardise_columns(df)


def test_missing_item_column_is_reported(spark):
    df = spark.createDataFrame([("a", 1, "2026-01-01"), ("b", 2, "2026-01-02"), ("a", 3, "2026-01-03"), ("b", 4, "2026-01-04")],
                               "user_type string, rating int, created_at string")
    found = detect_roles(df)
    assert found.roles.itemID is None
    assert any("itemID" in w for w in mapping_warnings(column_facts(df), found.roles))
