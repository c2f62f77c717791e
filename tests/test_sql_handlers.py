"""Handlers without Python: SQL in rule files, and SQL functions that a hook file names."""

import json

import pytest

from chainalerts.operators.handlers import function_handler
from chainalerts.operators.hooks import Catalog
from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources.sinks import write_text
from tests.conftest import amount, enabled, transfer


def catalog_of(**hooks):
    entries = {name: {"op_id": 2, "description": name, "function": f"own.{name}", "notif_code": "abc",
                      "filter": "", "options": {}} | entry for name, entry in hooks.items()}
    return Catalog.default().register({"own": {"enabled": True, "module_category": "Own"} | entries})


def sent(ops, catalog, wanted="own"):
    plan = AlertPlan(ops, catalog, hooks=[i for i in catalog.notifying_hooks() if i[1].module == wanted])
    rows = plan.notifications().orderBy("op_id", "account").collect()
    return [(r["op_id"], r["account"], r["remark"], r["verified"]) for r in rows], plan


def opened(make_ops, bodies, *accounts):
    rows = [(1, 18, enabled(name, {"own": ["*"]})) for name in accounts]
    return make_ops(rows + [(2, 2, body) for body in bodies])


def test_rows_from_a_rule_file(spark, make_ops, tmp_path):
    rule = {"enabled": True, "module_category": "Own", "big": {
        "op_id": 2, "description": "", "function": "own.big", "notif_code": "big", "filter": "", "options": {},
        "sql": {"where": "try_cast(amount1.amount AS BIGINT) >= 5000", "account": "v['to']", "amounts": {"amount": 0},
                "computed": {"shout": "upper(v['from'])"}, "remark": "concat(shown1, ' of ', shout)",
                "verified": "CAST(NULL AS BOOLEAN)"}}}
    write_text(spark, f"{tmp_path}/own/hooks.json", json.dumps(rule))
    bodies = [transfer("ann", raw="5000"), transfer("ann", raw="4999"), transfer("ann", raw="x"), {}, "broken"]
    rows, plan = sent(opened(make_ops, bodies, "ann"), Catalog.read(spark, str(tmp_path)))
    assert rows == []  # the preference hook is not in these files
    state = spark.createDataFrame([("ann", "own", ["*"], None)], "account STRING, module STRING, "
                                  "codes ARRAY<STRING>, opts MAP<STRING,MAP<STRING,STRING>>")
    plan.snapshot = state
    got = [(r["op_id"], r["account"], r["remark"], r["verified"]) for r in plan.notifications().collect()]
    assert got == [(1, "ann", "5 of BOB", None)]
    assert plan.rejects().count() == 0


def test_each_element_makes_a_row(make_ops):
    catalog = catalog_of(team={"sql": {
        "each": "split(v['to'], ',')", "where": "item <> v['from']", "account": "item", "remark": "length(item)",
        "gate": "nullif(item, 'dan') IS NOT NULL"}})
    bodies = [{"from": "bob", "to": "ann,bob,cyd,dan"}, {"from": "bob"}, {"to": "ann"}]
    rows, plan = sent(opened(make_ops, bodies, "ann", "bob", "cyd", "dan"), catalog)
    assert rows == [(4, "ann", "3", True), (4, "cyd", "3", True)]
    assert plan.rejects().count() == 0


def test_limits_and_rejects(make_ops):
    catalog = catalog_of(
        rich={"options": {"least": "number"}, "sql": {
            "account": "v['to']", "limit_key": "'least'", "limit_value": "try_cast(amount1.amount AS INT) DIV 1000",
            "amounts": {"amount": 0}}},
        strict={"notif_code": "str", "sql": {"account": "v['none']"}})
    options = {"required_auths": [], "required_posting_auths": ["ann"], "id": "gns",
               "json": [[1, "app"], "options", {"own": {"abc": {"least": 3}}}]}
    ops = make_ops([(1, 18, enabled("ann", {"own": ["abc"]})), (1, 18, options),
                    (2, 2, {"to": "ann", "amount": amount("2000")}), (2, 2, {"to": "ann", "amount": amount("3000")})])
    rows, plan = sent(ops, catalog)
    assert [r[:2] for r in rows] == [(3, "ann")]
    assert {(r["op_id"], r["notif_name"], r["reason"]) for r in plan.rejects().collect()} == {
        (2, "strict", "account is null"), (3, "strict", "account is null")}


def test_equal_names_of_two_catalogs_do_not_meet(make_ops):
    ops = opened(make_ops, [transfer("ann")], "ann")
    first, second = (catalog_of(own={"sql": {"account": "v['to']", "remark": f"'{n}'"}}) for n in (1, 2))
    assert [sent(ops, c)[0][0][2] for c in (first, second, first)] == ["1", "2", "1"]


@pytest.mark.parametrize("parts, told", [
    ({}, "no account"), ({"account": "v['a']", "acount": "1"}, "acount"), ({"account": 1}, "SQL texts"),
    ({"account": " "}, "SQL texts"),
])
def test_faulty_definitions(parts, told):
    with pytest.raises(ValueError, match=told):
        catalog_of(faulty={"sql": parts})


def test_functions_of_the_session(spark, make_ops):
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION both_ends(v MAP<STRING,STRING>)
        RETURNS ARRAY<STRUCT<account: STRING, remark: STRING>>
        RETURN array(named_struct('account', v['to'], 'remark', 'in'), named_struct('account', v['from'], 'remark', 'out'))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION receiver(v MAP<STRING,STRING>)
        RETURNS STRUCT<account: STRING> RETURN IF(v['to'] = 'ann', named_struct('account', v['to']), NULL)""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION no_rows(v MAP<STRING,STRING>) RETURNS STRING RETURN v['to']")
    ops = opened(make_ops, [transfer("ann"), transfer("cyd")], "ann", "bob")
    catalog = catalog_of(both_ends={}, receiver={"notif_code": "rec"})
    rows, _ = sent(ops, catalog)
    assert rows == [(2, "ann", "in", True), (2, "ann", None, True), (2, "bob", "out", True), (3, "bob", "out", True)] or \
        rows == [(2, "ann", None, True), (2, "ann", "in", True), (2, "bob", "out", True), (3, "bob", "out", True)]
    with pytest.raises(ValueError, match="no recipients"):
        function_handler(spark, "no_rows")
    with pytest.raises(ValueError, match="nowhere"):
        sent(ops, catalog_of(nowhere={}))[1]


def test_plan_stays_one_pass(make_ops):
    catalog = catalog_of(**{f"h{n}": {"sql": {"account": "v['to']", "remark": f"'{n}'"}} for n in range(20)})
    _, plan = sent(opened(make_ops, [transfer("ann")], "ann"), catalog)
    text = plan.candidates()._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate") == 1 and text.count("Join") == 1 and "PythonUDF" not in text
