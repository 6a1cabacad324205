"""Quality rules against counts made by hand."""

import pytest

from tablemill import Rule, SpecError, check
from tablemill import quality as dq


def report(frame):
    return {(r["rule"], r["column"]): (r.n_rows, r.n_failed, r.passed) for r in frame.collect()}


def test_rules_on_customers(shop):
    result = check(
        shop["customers"],
        [
            dq.not_null("customer_id"),
            dq.not_null("customer_name"),
            dq.in_range("total_spent", low=100, high=9000),
            dq.allowed_values("customer_name", ["Ann", "Bob"]),
            dq.min_rows(10),
            dq.min_rows(12),
            dq.unique_key("customer_id"),
            dq.unique_key("customer_id", "total_spent"),
        ],
    )
    assert result.columns == ["rule", "column", "n_rows", "n_failed", "passed"]
    lines = [tuple(r) for r in result.collect()]
    assert sorted(lines) == sorted(
        [
            ("not_null", "customer_id", 10, 1, False),
            ("not_null", "customer_name", 10, 0, True),
            ("in_range", "total_spent", 10, 4, False),
            ("allowed_values", "customer_name", 10, 8, False),
            ("min_rows", "", 10, 0, True),
            ("min_rows", "", 10, 2, False),
            ("unique_key", "customer_id", 10, 2, False),
            ("unique_key", "customer_id,total_spent", 10, 0, True),
        ]
    )


def test_orphans(shop):
    result = check(
        shop["orders"],
        [
            dq.orphan_key("product_id", "products"),
            dq.orphan_key("customer_id", "people", ("id",)),
        ],
        {"products": shop["products"], "people": shop["customers"].selectExpr("customer_id AS id")},
    )
    assert report(result) == {
        ("orphan_key", "product_id"): (14, 1, False),
        ("orphan_key", "customer_id"): (14, 0, True),
    }


def test_composite_orphans(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, 2)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1), (1, None)], "a int, b int")
    result = check(child, [dq.orphan_key(("a", "b"), "p")], {"p": parent})
    assert report(result) == {("orphan_key", "a,b"): (4, 2, False)}


def test_empty_frame_passes(spark):
    empty = spark.createDataFrame([], "a int")
    rules = [dq.not_null("a"), dq.unique_key("a"), dq.orphan_key("a", "p"), dq.min_rows(1)]
    result = report(check(empty, rules, {"p": empty}))
    assert result.pop(("min_rows", "")) == (0, 1, False)
    assert set(result.values()) == {(0, 0, True)}


def test_hot_and_null_keys(spark):
    frame = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN id END AS k")
    assert report(check(frame, [dq.unique_key("k")])) == {("unique_key", "k"): (9000, 3001, False)}


def test_row_rules_share_one_scan(shop):
    rules = [dq.not_null("customer_id"), dq.in_range("total_spent", low=0), dq.min_rows(1)]
    plan = check(shop["customers"], rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_rules_from_a_spec():
    rule = Rule.from_dict({"rule": "in_range", "column": "x", "low": 0})
    assert rule.columns == ("x",) and rule.options == {"low": 0}
    assert Rule.from_dict({"rule": "unique_key", "columns": ["a", "b"]}).label == "a,b"


@pytest.mark.parametrize(
    "raw",
    [
        {"rule": "pretty", "column": "x"},
        {"column": "x"},
        {"rule": "not_null"},
        {"rule": "not_null", "columns": ["x", "y"]},
        {"rule": "in_range", "column": "x"},
        {"rule": "in_range", "column": "x", "min": 1},
        {"rule": "allowed_values", "column": "x", "values": []},
        {"rule": "orphan_key", "column": "x"},
        {"rule": "orphan_key", "column": "x", "parent": "p", "parent_columns": ["a", "b"]},
        {"rule": "min_rows"},
    ],
)
def test_wrong_rules(raw):
    with pytest.raises(SpecError):
        Rule.from_dict(raw)


def test_wrong_checks(shop):
    with pytest.raises(SpecError):
        check(shop["orders"], [])
    with pytest.raises(SpecError, match="products"):
        check(shop["orders"], [dq.orphan_key("product_id", "products")])


def test_null_among_allowed_values(spark):
    frame = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    for values, failed in ((["A", None], 1), (["A", "B"], 0), ([None], 2)):
        found = dq.check(frame, [dq.allowed_values("c", values)]).first()
        assert (found.n_failed, found.passed) == (failed, failed == 0)


ROWS = [
    (1, 1, "a", 1.0),
    (1, 2, "a", None),
    (None, 2, "b", 3.0),
    (None, 2, "b", 3.0),
    (3, None, None, 3.0),
    (3, None, "c", None),
    (4, 5, "d", None),
]


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame(ROWS, "a int, b int, c string, d double")


def doubled(*places):
    """Rows whose key, without NULL parts, others share."""
    keys = [tuple(row[i] for i in places) for row in ROWS]
    return sum(None not in key and keys.count(key) > 1 for key in keys)


@pytest.mark.parametrize(
    "keys",
    [
        ["a", "b", "c"],
        # Overlapping and nested keys, one given twice.
        ["ab", "bc", "c", "abd", "bc"],
        ["a", "bc", "d"],
    ],
)
def test_unique_keys_share_one_scan(keyed, keys):
    result = check(keyed, [dq.unique_key(*key) for key in keys])
    found = [((r["rule"], r["column"]), (r.n_rows, r.n_failed, r.passed)) for r in result.collect()]
    expected = [
        (("unique_key", ",".join(key)), (7, n, n == 0))
        for key in keys
        for n in [doubled(*("abcd".index(c) for c in key))]
    ]
    assert sorted(found) == sorted(expected)
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_unique_keys_of_nothing_and_with_a_hot_key(spark, keyed):
    rules = [dq.unique_key("a"), dq.unique_key("b")]
    assert set(report(check(keyed.where("false"), rules)).values()) == {(0, 0, True)}
    hot = spark.range(9000).selectExpr("IF(id % 3 = 0, 1, id + 10) AS a", "id AS b")
    assert report(check(hot, rules)) == {
        ("unique_key", "a"): (9000, 3000, False),
        ("unique_key", "b"): (9000, 0, True),
    }


def test_failing_rows_name_their_rules(spark, keyed):
    parents = {"known": spark.createDataFrame([(1, 1), (2, None)], "x int, y int")}
    rules = [
        dq.not_null("c"),
        dq.in_range("d", high=2),
        dq.unique_key("a"),
        dq.unique_key("b", "c"),
        dq.orphan_key(("a", "b"), "known", ("x", "y")),
        dq.min_rows(100),
    ]
    found = dq.failing_rows(keyed, rules, parents)
    assert found.columns == ["a", "b", "c", "d", "failed_rules"]
    got = sorted(((*r[:4], tuple(r[4])) for r in found.collect()), key=str)
    expected = [
        (*ROWS[0], ("unique_key(a)",)),
        (*ROWS[1], ("unique_key(a)", "orphan_key(a,b)")),
        *[(*ROWS[2], ("in_range(d)", "unique_key(b,c)"))] * 2,
        (*ROWS[4], ("not_null(c)", "in_range(d)", "unique_key(a)")),
        (*ROWS[5], ("unique_key(a)",)),
        (*ROWS[6], ("orphan_key(a,b)",)),
    ]
    assert got == sorted(expected, key=str)
    # As many as the report counts, rule by rule.
    counts = report(check(keyed, rules[:-1], parents))
    named = [name for r in got for name in r[4]]
    assert {f"{k}({c})": n for (k, c), (_, n, _) in counts.items()} == {n: named.count(n) for n in named}
    assert dq.failing_rows(keyed.where("false"), rules, parents).count() == 0


def test_failing_rows_need_rules_about_rows(keyed):
    with pytest.raises(SpecError):
        dq.failing_rows(keyed, [dq.min_rows(1)])
    with pytest.raises(SpecError, match="failed_rules"):
        dq.failing_rows(keyed.selectExpr("*", "1 AS failed_rules"), [dq.not_null("a")])
