"""Logs whose bodies are landed as shredded VARIANT read as the text logs do."""

import json

import pytest
from pyspark.sql import functions as F

from chainalerts.operators.handlers import fields_read, sql_handler
from chainalerts.operators.hooks import Catalog, dispatch
from chainalerts.operators.preferences import preference_log
from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources import op_log
from chainalerts.sources.shredded import SETTINGS, read_shredded, with_variant, write_shredded
from tests.conftest import amount, enabled, preference, transfer

ODD = [
    None, "", "{bad", "[1]", "7", '{"type": "x"}', '{"value": 7}', '{"value": {}}',
    '{"value": {"to": "a", "to": "b", "from": null}}',
    '{"value": {"to": "c"}, "value": {"to": "d"}}',
    '{"value": {"to": "e", "from": 1.50, "memo": 1e3, "id": 123456789012345678901234567890}}',
    '{"value": {"to": true, "memo": "{not json", "from": "[1, 2]"}}',
    '{"value": {"to": "f", "amount": {"amount": "5", "amount": "6", "precision": 3, "nai": "@@000000013"}}}',
    '{"value": {"memo": "\\u00e9\\ud83d\\ude00 \\"quoted\\"", "to": "g", "na me": "x", "": "empty"}}',
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def ops(make_ops):
    order = {"owner": "v", "orderid": 7}
    text_amount = transfer("u3") | {"amount": json.dumps(amount("7000"))}
    return make_ops(
        [(b, 2, transfer(f"u{b % 5}", raw=str(b))) for b in range(1, 30)]
        + [(b, 6, order | {"orderid": b}) for b in range(1, 30)]
        + [(5, 2, text_amount), (6, 2, transfer("u1") | {"amount": 5}), (6, 2, {"to": "u1"})]
        + [(2, 18, enabled("u1", {"currency": ["*"]})), (3, 18, enabled("u3", {"currency": ["*"]}, True)),
           (4, 18, preference("u2", "no list")), (4, 18, preference("u2", "{", True))]
        + [(7, 2, body) for body in ODD]
    )


@pytest.fixture(scope="module")
def landed(spark, ops, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('log')}/ops"
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    write_shredded(ops, path, bucket=10)
    assert {key: spark.conf.get(key, None) for key in SETTINGS} == before
    return read_shredded(spark, path)


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame(
        [(f"u{k}", "currency", ["*"], None) for k in range(5)],
        "account STRING, module STRING, codes ARRAY<STRING>, opts MAP<STRING,MAP<STRING,STRING>>")


def scan(frame):
    """The columns that the scans of an executed plan read."""
    plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan, [line for line in plan.splitlines() if line.startswith("ReadSchema")]


def test_text_is_kept_and_directories_are_by_type(ops, landed, tmp_path):
    assert rows(landed.select(*ops.columns)) == rows(ops)
    files = landed.where("op_type_id = 6 AND block_num BETWEEN 12 AND 15").where(
        "bucket_first <= 15 AND bucket_last >= 12").select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "bucket_first=10/bucket_last=19/op_type_id=6" in files[0][0]


def test_values_are_those_of_the_text(ops, landed):
    def shown(log, fields):
        entries = "transform(array('to', 'from', 'memo', 'id', 'na me', '', 'none'), k -> v[k])"
        return rows(op_log.parse_values(log, fields).selectExpr("op_id", entries))

    assert shown(ops, None) == shown(landed, None)
    assert shown(ops, None) == shown(landed, ["to", "from", "memo", "id", "na me", "", "none"])


def test_first_of_repeated_keys_counts(spark, make_ops):
    odd = with_variant(make_ops([(1, 2, '{"value": {"to": "a", "to": "b"}}')]))
    assert odd.selectExpr("to_json(val)").first()[0] == '{"to":"a"}'


def test_names_that_make_no_path(landed):
    found = op_log.parse_values(landed.where("op_type_id = 6"), ["it's", "owner"])
    assert {r["x"] for r in found.selectExpr("v['owner'] AS x").collect()} == {"v"}


@pytest.mark.parametrize("op_type", [2, 6, 18])
def test_typed_fields(ops, landed, op_type):
    plain = "block_num <> 7 AND op_id <> 58"
    assert rows(op_log.typed_ops(landed, op_type).where(plain)) == rows(op_log.typed_ops(ops, op_type).where(plain))


def test_typed_fields_written_as_strings(ops, landed):
    def paid(log):
        return op_log.typed_ops(log, 2).where("op_id = 58").select("amount.amount").first()[0]

    assert paid(ops) is None and paid(landed) == "7000"


def test_typed_fields_come_from_columns(landed):
    plan, read = scan(op_log.typed_ops(landed, 6))
    assert "from_json" not in plan and len(read) == 1
    assert "body:" not in read[0] and "val:struct<" in read[0]


def test_dispatch_reads_the_named_fields(ops, landed):
    catalog = Catalog.default()
    chosen = catalog.notifying_hooks()
    fields = fields_read([hook.funct for _, hook in chosen], "reference")
    assert fields and {"from", "to", "amount", "author"} <= fields
    met = dispatch(op_log.parse_values(landed.drop("body"), fields), catalog, chosen)
    plan, read = scan(met)
    assert "from_json" not in plan and any("val:struct<" in line for line in read)
    names = ["op_id", "hook_ord", "v['to']", "v['from']"]
    assert rows(met.selectExpr(*names)) == rows(
        dispatch(op_log.parse_values(ops), catalog, chosen).selectExpr(*names))


def test_a_handler_that_looks_at_any_field(landed):
    name = sql_handler("sizes", {"account": "v['to']", "where": "size(map_keys(v)) > 3"})
    assert fields_read([name], "reference") is None
    assert fields_read([sql_handler("named", {"account": "v['to']"})], "reference") == {"to"}


def test_alerts(ops, landed, state):
    text, shredded = (AlertPlan(log, snapshot=state) for log in (ops, landed))
    assert rows(shredded.notifications()) == rows(text.notifications())
    assert shredded.notifications().count() > 29
    assert rows(shredded.rejects()) == rows(text.rejects())
    kept = ["op_id", "account", "op_name", "outcome", "reason"]
    assert rows(preference_log(landed, Catalog.default()).select(*kept)) == rows(
        preference_log(ops, Catalog.default()).select(*kept))


def test_filters(ops, landed):
    for wanted in ({"from": "bob"}, {"to": "u1", "id": "gns"}, {"id": "none"}):
        assert rows(op_log.filter_operations(landed, 2, 20, wanted).select(*ops.columns)) == rows(
            op_log.filter_operations(ops, 2, 20, wanted))


def test_empty_log(spark, ops, tmp_path):
    write_shredded(ops.where("false"), f"{tmp_path}/none")
    assert read_shredded(spark, f"{tmp_path}/none").count() == 0
