"""Filtered hooks by their index."""

import json

import pytest
from pyspark.sql import functions as F

from chainalerts.operators.hooks import Catalog, dispatch, filter_index
from chainalerts.sources.op_log import parse_values


def catalog_of(filters, op_id=2):
    entries = {
        f"h{n:05d}": {"op_id": op_id, "description": "", "function": "core_transfer", "notif_code": "abc",
                      "filter": wanted, "options": {}} for n, wanted in enumerate(filters)}
    return Catalog({}, ()).register({"many": {"enabled": True, "module_category": "Many"} | entries})


def passes(wanted, body):
    if wanted == "":
        return True
    try:
        wanted = json.loads(wanted) if isinstance(wanted, str) else wanted
    except ValueError:
        return False
    if not isinstance(wanted, dict):
        return False
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    return all(text(body.get(k)) == text(v) for k, v in wanted.items())


FILTERS = [
    "", {}, {"to": "a"}, {"to": "a", "from": "b"}, {"from": "b"}, {"to": "z"}, {"n": 5}, {"n": "5", "to": "a"},
    {"gone": None}, {"gone": None, "to": "a"}, {"memo": ""}, "{}", "not json", "[1]", {"flag": True}, {"to": "a'\\\"é"},
]


def test_like_testing_each(spark, make_ops):
    bodies = [{"to": "a", "from": "b", "n": 5}, {"to": "a", "from": "c", "memo": ""}, {"to": "b", "n": "5", "gone": "x"},
              {}, {"flag": True, "to": "a'\\\"é"}, {"to": None, "from": "b"}]
    ops = make_ops([(n, 2, body) for n, body in enumerate(bodies)] + [(99, 3, bodies[0]), (99, 2, "broken")])
    catalog = catalog_of(FILTERS)
    found = dispatch(parse_values(ops), catalog)
    assert found.columns == [*parse_values(ops).columns, "module", "notif_name", "notif_code", "funct", "notif_filter", "hook_ord"]
    got = sorted((r["block_num"], r["hook_ord"]) for r in found.where("block_num < 99").collect())
    assert got == [(n, k) for n, body in enumerate(bodies) for k, wanted in enumerate(FILTERS, 1) if passes(wanted, body)]
    assert {r["hook_ord"] for r in found.where("block_num = 99").collect()} == {1, 2, 9, 12}  # nothing is there


def test_each_rule_is_looked_up_once(spark):
    catalog = catalog_of([{"to": "a", "from": f"s{n}"} for n in range(500)] + FILTERS)
    rules = catalog.hooks_frame(spark).withColumn("op_type_id", F.col("op_id")).drop("op_id")
    rows = filter_index(rules).collect()
    assert len(rows) == len({r["hook_ord"] for r in rows}) == 500 + len(FILTERS) - 2  # two are no maps
    assert {r["on_key"] for r in rows if r["hook_ord"] <= 500} == {"from"}  # the rarer field


@pytest.mark.parametrize("n", [10, 3000])
def test_plan_does_not_grow_with_the_rules(spark, make_ops, n):
    ops = make_ops([(k, 2, {"to": f"u{k}", "from": "x"}) for k in range(20)])
    found = dispatch(parse_values(ops), catalog_of([{"to": f"u{k}", "from": "x"} for k in range(n)]))
    assert found.count() == min(n, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and len(plan) < 6000


@pytest.mark.parametrize("filters", [[""], [{"to": f"u{k}"} for k in range(300)]])
def test_rules_go_to_the_log(spark, make_ops, filters):
    """Spark knows the rules' size, so the log is not shuffled by its operation types; beyond the threshold it is."""
    ops = make_ops([(k, 2, {"to": f"u{k}", "from": "x"}) for k in range(20)])
    catalog, plans, found = catalog_of(filters), [], []
    for threshold in ("256k", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            met = dispatch(parse_values(ops), catalog)
            plans.append(met._jdf.queryExecution().executedPlan().toString())
            found.append(sorted((r["op_id"], r["hook_ord"]) for r in met.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and len(found[0]) == 20
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert "SortMergeJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]


def test_frames_of_an_empty_catalog(spark):
    empty = Catalog({}, ())
    assert empty.hooks_frame(spark).collect() == [] == empty.modules_frame(spark).collect()
