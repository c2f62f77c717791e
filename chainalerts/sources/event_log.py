"""An operation log derived from the ``events`` table.

``events`` is an ordered log; every event becomes one operation with a JSON body, so
that all of the engine can be run and checked on data at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

from chainalerts import schemas
from chainalerts.constants import HBD, PREFERENCE_ID, TOKEN_TRANSFER_ID
from chainalerts.functions.json_values import bind

HIVE = "@@000000021"
VESTS = "@@000000037"
UNKNOWN = "@@000000099"

# Operation types by event type; errors stand for five types by ``event_id mod 5``.
OP_TYPE = """CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 72 WHEN 'view' THEN 1
    WHEN 'signup' THEN 18 ELSE CASE event_id % 5 WHEN 0 THEN 40 WHEN 1 THEN 51 WHEN 2 THEN 63
    WHEN 3 THEN 52 ELSE 50 END END"""


# How many tasks the events are dealt to; a setting of the session, as split sizes are. Without it
# Spark deals them by their size. The files' own splits would not do: an event of 20 bytes becomes an
# operation that takes a hundred microseconds to make and parse, and a block range lies in few splits.
READ_TASKS = "spark.chainalerts.readTasks"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    tasks = spark.conf.get(READ_TASKS, None)
    return table.repartition(int(tasks)) if tasks else table.hint("rebalance")


def _amount(raw: str, asset: str, precision: int = 3) -> str:
    return (
        f"named_struct('amount', CAST({raw} AS STRING), 'precision', {precision}, 'nai', {asset})"
    )


def _body(name: str, fields: dict[str, str]) -> str:
    value = ", ".join(f"'{key}', {expression}" for key, expression in fields.items())
    return f"to_json(named_struct('type', '{name}_operation', 'value', named_struct({value})))"


def _bodies() -> dict[int, str]:
    """Operation type -> its body as an SQL expression."""
    permlink = "concat('p', event_id)"
    payouts = {
        "hbd_payout": _amount("cents", f"'{HBD}'"), "hive_payout": _amount("0", f"'{HIVE}'"),
        "vesting_payout": _amount("cents", f"'{VESTS}'", 6),
    }
    asset = (
        f"CASE event_id % 4 WHEN 0 THEN '{HBD}' WHEN 1 THEN '{HIVE}' WHEN 2 THEN '{VESTS}' "
        f"ELSE '{UNKNOWN}' END"
    )
    none = "CAST(array() AS ARRAY<STRING>)"
    is_token = "event_id % 10 = 9"
    token_payload = "to_json(named_struct('to', u, 'qty', value, 'token', 'DEC', 'memo', ''))"
    return {
        1: _body("comment", {
            "parent_author": "IF(k < 50, u, '')",
            "parent_permlink": "IF(k < 50, concat('p', k), 'tag')",
            "author": "p", "permlink": "concat('c', event_id)", "title": "''",
            "body": "concat('hi @', u, ', it is @', p, ' writing to @', u, '; ask a@mail', "
                    "k % 10, '.org')",
            "json_metadata": "'{}'",
        }),
        2: _body("transfer", {
            "from": "p", "to": "u", "amount": _amount("cents * 10", asset), "memo": "''",
        }),
        18: _body("custom_json", {
            "required_auths": f"IF({is_token}, array(p), {none})",
            "required_posting_auths": f"IF({is_token}, {none}, array(u))",
            "id": f"IF({is_token}, '{TOKEN_TRANSFER_ID}', '{PREFERENCE_ID}')",
            "json": f"IF({is_token}, {token_payload}, {_preference_payload()})",
        }),
        40: _body("delegate_vesting_shares", {
            "delegator": "p", "delegatee": "u",
            "vesting_shares": _amount("IF(k < 20, 0, cents * 10000)", f"'{VESTS}'", 6),
        }),
        50: _body("fill_convert_request", {
            "owner": "u", "requestid": "event_id",
            "amount_in": _amount("cents", f"IF(k % 2 = 1, '{HIVE}', '{HBD}')"),
            "amount_out": _amount("cents", f"IF(k % 2 = 1, '{HBD}', '{HIVE}')"),
        }),
        51: _body("author_reward", {
            "author": "u", "permlink": permlink, **payouts,
            "curators_vesting_payout": _amount("0", f"'{VESTS}'", 6),
            "payout_must_be_claimed": "true",
        }),
        52: _body("curation_reward", {
            "curator": "u", "reward": _amount("cents", f"'{VESTS}'", 6),
            "comment_author": "p", "comment_permlink": permlink,
            "payout_must_be_claimed": "true",
        }),
        63: _body("comment_benefactor_reward", {
            "benefactor": "u", "author": "p", "permlink": permlink, **payouts,
        }),
        72: _body("effective_comment_vote", {
            "voter": "p", "author": "u", "permlink": permlink, "weight": "k",
            "total_vote_weight": "100", "pending_payout": _amount("cents", f"'{HBD}'"),
        }),
    }


def _preference_payload() -> str:
    """Text of the preference payload by ``event_id mod 10``."""
    def op(name: str, data: str) -> str:
        return f"""concat('[[1,"app/1.0"],"{name}",', {data}, ']')"""

    limits = """concat('{"currency":{"trn":{"min_hbd":', k, ',"min_hive":', k / 2, '}}}')"""
    as_text = """concat('{"currency":{"trn":{"min_hbd":"', k, '"}}}')"""
    enabled = {
        2: """'{"currency":["*"],"social":["vot"]}'""",
        3: """'{"currency":[]}'""",
        4: """'{"social":["com","men"],"currency":["del","arw"]}'""",
        5: """'{"currency":["zzz"],"social":["vot"]}'""",
    }
    whens = " ".join(f"WHEN {rest} THEN {op('enabled', data)}" for rest, data in enabled.items())
    trn = """'{"currency":["trn"]}'"""
    return (
        f"CASE event_id % 10 WHEN 0 THEN {op('enabled', trn)} WHEN 1 THEN {op('enabled', trn)} "
        f"{whens} WHEN 6 THEN {op('options', limits)} WHEN 7 THEN {op('options', as_text)} "
        """ELSE '["enabled",{"currency":["*"]}]' END"""
    )


def _read_payload() -> str:
    """Read marks by ``event_id div 10 mod 6``: known and unknown pairs, ``all``, NULL."""
    marks = ["""'["read",["currency.trn"]]'""", """'["read",["all"]]'""",
             """'["read",[null,"social.vot"]]'""", """'["read",["foo.bar","currency.trn"]]'""",
             """'[[1,"app"],"read",["social.vot","social.vot"]]'""", """'["read",[null]]'"""]
    whens = " ".join(f"WHEN {rest} THEN {payload}" for rest, payload in enumerate(marks))
    return f"CASE event_id DIV 10 % 6 {whens} END"


def read_mark_ops(source: DataFrame) -> DataFrame:
    """Preference operations that mark as read, one for each sign-up event."""
    signups = source.where("event_type = 'signup'").selectExpr(
        "event_id", "ts", "concat('u', 1000 + user_id) AS u")
    body = _body("custom_json", {
        "required_auths": "CAST(array() AS ARRAY<STRING>)", "required_posting_auths": "array(u)",
        "id": f"'{PREFERENCE_ID}'", "json": _read_payload(),
    })
    return signups.selectExpr(
        "event_id AS op_id", "CAST(18 AS SMALLINT) AS op_type_id",
        "CAST(event_id DIV 10 AS INT) AS block_num", "ts",
        "CAST(event_id % 10 AS INT) AS trx_in_block", f"{body} AS body",
    )


def _sample_value(name: str, kind: DataType) -> str:
    """A value for a documented field, of its type, from the event."""
    if isinstance(kind, StructType):
        if kind.names == ["amount", "precision", "nai"]:
            return _amount("cents", f"'{HIVE}'")
        inner = ", ".join(f"'{f.name}', {_sample_value(f.name, f.dataType)}" for f in kind)
        return f"named_struct({inner})"
    if isinstance(kind, ArrayType):
        return f"array({_sample_value(name, kind.elementType)})"
    if isinstance(kind, BooleanType):
        return "event_id % 2 = 0"
    return f"concat('{name}', event_id)" if isinstance(kind, StringType) else "event_id"


def documented_ops_from_events(source: DataFrame) -> DataFrame:
    """A log of every documented operation type, by ``event_id`` modulo their number."""
    kinds = sorted(schemas.OPERATIONS)
    whens, types = [], []
    for rest, op in enumerate(kinds):
        name, ddl = schemas.OPERATIONS[op]
        fields = {f.name: _sample_value(f.name, f.dataType) for f in StructType.fromDDL(ddl)}
        whens.append(f"WHEN {rest} THEN {_body(name, fields)}")
        types.append(f"WHEN {rest} THEN {op}")
    kind = f"event_id % {len(kinds)}"
    return source.selectExpr(
        "event_id", "ts", "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents",
    ).selectExpr(
        "event_id AS op_id", f"CAST(CASE {kind} {' '.join(types)} END AS SMALLINT) AS op_type_id",
        "CAST(event_id DIV 10 AS INT) AS block_num", "ts", "CAST(NULL AS INT) AS trx_in_block",
        f"CASE {kind} {' '.join(whens)} END AS body",
    )


def ops_from_events(source: DataFrame) -> DataFrame:
    """The ``ops`` table: op_id, op_type_id, block_num, ts, trx_in_block, body."""
    named = source.selectExpr(
        "event_id", "ts", "event_type", "value", "user_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents",
        f"CAST({OP_TYPE} AS SMALLINT) AS op_type_id",
    ).selectExpr(
        "*", "concat('u', 1000 + user_id) AS u", "concat('u', 1001 + user_id + k) AS p"
    )
    whens = " ".join(f"WHEN {op} THEN {body}" for op, body in _bodies().items())
    # In a lambda: as one CASE of the projection all bodies end up in one generated method, which
    # is longer than the JIT compiles and would be interpreted for every event.
    body = bind("op_type_id", "op", f"CASE op {whens} END")
    return named.selectExpr(
        "event_id AS op_id", "op_type_id", "CAST(event_id DIV 10 AS INT) AS block_num", "ts",
        "IF(op_type_id < 50, CAST(event_id % 10 AS INT), NULL) AS trx_in_block",
        f"{body} AS body",
    )


def transactions_from_events(source: DataFrame) -> DataFrame:
    """One transaction per operation that has one; hash = md5 of the event id text."""
    return source.where(f"{OP_TYPE} < 50").selectExpr(
        "CAST(event_id DIV 10 AS INT) AS block_num", "CAST(event_id % 10 AS INT) AS trx_in_block",
        "unhex(md5(CAST(event_id AS STRING))) AS trx_hash",
    )


def blocks_from_events(source: DataFrame) -> DataFrame:
    return source.selectExpr("CAST(event_id DIV 10 AS INT) AS num").distinct()


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_from_events(events(spark, sf_dir))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(events(spark, sf_dir))
