"""Specs and parameters: what is accepted, and errors before any read."""

import datetime as dt
from decimal import Decimal

import pytest

from tablemill import JobSpec, ParameterError, SpecError, shipped_job, shipped_jobs
from tablemill.params import ParamSpec, bind_params, fill_name, parse_params
from tablemill.spec import SourceSpec


def test_missing_file_is_reported(tmp_path):
    with pytest.raises(FileNotFoundError):
        JobSpec.load(tmp_path / "none.yaml")


def test_spec_without_sources_or_query_loads():
    spec = JobSpec.from_dict({"query": {}, "mapping": {}})
    assert spec.sources == {} and spec.sql is None and spec.target_table is None


@pytest.mark.parametrize(
    "raw, is_query",
    [
        ({"type": "table", "query": "orders_table"}, False),
        ({"type": "table", "table": "orders_table"}, False),
        ({"type": "table", "query": "  select a FROM t"}, True),
        ({"type": "table", "query": "(WITH x AS (SELECT 1) SELECT * FROM x)"}, True),
        ({"type": "table", "query": "selections"}, False),
        ({"type": "query", "query": "SELECT 1"}, True),
    ],
)
def test_source_forms(raw, is_query):
    assert SourceSpec.from_dict("s", raw).is_query is is_query


@pytest.mark.parametrize("raw", [{"type": "stream", "query": "x"}, {"query": "x"}])
def test_unknown_source_type(raw):
    with pytest.raises(ValueError, match="Unknown source type"):
        SourceSpec.from_dict("s", raw)


@pytest.mark.parametrize(
    "raw",
    [
        {"sources": {"s": {"type": "query"}}},
        {"sources": {"s": {"type": "query", "table": "t"}}},
        {"qurey": {}},
        {"query": "SELECT 1"},
        {"query": {}, "sources": ["a"]},
        {"mapping": {"a": 1}},
        {"mapping": ["a"]},
        {"sink": "table"},
        {"params": {"p": "2024-01-01"}},
        {"sink": {"mode": "append"}},
        {"params": {"p": {"type": "int"}}},
        {"params": {"p": {"type": "number", "default": 1}}},
        {"params": {"p": {"type": "int", "default": "many"}}},
    ],
)
def test_wrong_specs(raw):
    with pytest.raises(SpecError):
        JobSpec.from_dict(raw)


def test_template_files(tmp_path):
    plain = tmp_path / "one.yaml.j2"
    plain.write_text("query: {target_table: t, sql: SELECT 1}")
    assert JobSpec.load(plain).job_name == "one"
    marked = tmp_path / "two.yaml.j2"
    marked.write_text("query: {target_table: 't_{{ day }}', sql: SELECT 1}")
    with pytest.raises(SpecError, match="params"):
        JobSpec.load(marked)


def test_shipped_jobs_load():
    assert shipped_jobs() == [
        "customer_order_frequency",
        "customer_sales_summary",
        "product_inventory_report",
        "product_sales_summary",
    ]
    for name in shipped_jobs():
        assert shipped_job(name).sql
    with pytest.raises(SpecError):
        shipped_job("groups")


def test_inventory_defaults():
    params = shipped_job("product_inventory_report").params
    values = bind_params(params, {"report_date": "2024-08-01"})
    assert values == {
        "report_date": dt.date(2024, 8, 1),
        "min_stock_threshold": 50,
        "category_filter": None,
        "critical_stock_level": 10,
        "low_stock_level": 30,
    }


def test_json_parameters():
    assert parse_params('{"a": 1, "b": 0.10}') == {"a": 1, "b": Decimal("0.10")}
    assert parse_params("") == {}
    for text in ("{", "[1]", "3"):
        with pytest.raises(ParameterError):
            parse_params(text)


@pytest.mark.parametrize(
    "kind, given, value",
    [
        ("int", "7", 7),
        ("int", 7.0, 7),
        ("decimal", "0.10", Decimal("0.10")),
        ("double", "1.5", 1.5),
        ("boolean", "False", False),
        ("date", "2024-02-29", dt.date(2024, 2, 29)),
        ("timestamp", "2024-02-29T01:02:03", dt.datetime(2024, 2, 29, 1, 2, 3)),
        ("timestamp", dt.date(2024, 2, 29), dt.datetime(2024, 2, 29)),
        ("string", 5, "5"),
    ],
)
def test_conversions(kind, given, value):
    assert ParamSpec("p", kind, required=True).bind({"p": given}) == value


@pytest.mark.parametrize(
    "kind, given",
    [
        ("int", "7.5"),
        ("int", 7.5),
        ("int", True),
        ("int", ""),
        ("decimal", "much"),
        ("boolean", "yes"),
        ("date", "2023-02-29"),
        ("date", dt.datetime(2024, 1, 1)),
        ("string", ["a"]),
    ],
)
def test_wrong_values(kind, given):
    with pytest.raises(ParameterError):
        ParamSpec("p", kind, required=True).bind({"p": given})


def test_unknown_and_missing_parameters():
    declared = {"p": ParamSpec("p", "int", required=True)}
    with pytest.raises(ParameterError, match="unknown"):
        bind_params(declared, {"p": 1, "q": 2})
    with pytest.raises(ParameterError, match="required"):
        bind_params(declared, {})


def test_names():
    day = {"day": dt.date(2024, 8, 1), "none": None, "bad": "../x"}
    assert fill_name("report_{day}", day) == "report_2024-08-01"
    for template in ("report_{none}", "report_{other}", "report_{bad}"):
        with pytest.raises(ParameterError):
            fill_name(template, day)


@pytest.mark.parametrize("number", ["10.5", "9.99", "1e-3", "true", '"10.5"', '"x"', "[1]"])
def test_whole_numbers_are_never_cut(number):
    declared = {"t": ParamSpec.from_dict("t", {"type": "int", "required": True})}
    with pytest.raises(ParameterError):
        bind_params(declared, '{"t": %s}' % number)


@pytest.mark.parametrize("number, value", [("10", 10), ("10.0", 10), ("1e3", 1000), ('"7"', 7)])
def test_whole_numbers_from_json(number, value):
    declared = {"t": ParamSpec.from_dict("t", {"type": "int", "required": True})}
    assert bind_params(declared, '{"t": %s}' % number) == {"t": value}


@pytest.mark.parametrize(
    "more",
    [
        {"on_failed_rule": "stop"},
        {"settings": {"spark.executor.memory": "1g"}},
        {"sum_types": {"a": "nothing.b"}},
        {"sum_types": {"a": "b"}},
    ],
)
def test_wrong_job_options(more):
    with pytest.raises(SpecError):
        JobSpec.from_dict({"query": {"sql": "SELECT 1"}, **more})
