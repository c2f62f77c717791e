"""Notification handlers: an operation's values -> its recipients.

A handler is a function of the semantics mode that gives an SQL expression of type
``ARRAY<RECIPIENT>``. All handlers become one CASE over the hook's function, so the log
is read and parsed once whatever the number of rules. A handler reads:

* ``v['key']``: a field's text, or the raw JSON of a node;
* ``amount1.amount``, ``amount1.nai``, ``shown1``: raw text, asset id and printed text of
  its first declared amount; 2 and 3 likewise;
* ``nodes.key.field``: a field of a declared JSON node;
* its own computed columns by name, each of them worked out once.

Handlers need no Python: a rule file may give one as SQL (``sql_handler``), or name an SQL function
that was created in the session (``function_handler``). Either ends up in the same CASE, as
Spark puts an SQL function's body in its call's place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from chainalerts.constants import (
    ASSET_IDS, ASSETS, HBD, LINK_BASE, MAX_ACCOUNT, MAX_ASSET, MAX_MEMO, MAX_TEXT,
    TOKEN_TRANSFER_ID,
)
from chainalerts.functions.json_values import first_element, from_text, struct
from chainalerts.functions.text import (
    amount_text, cents_of_float, float_text, mentioned_names, text,
)

# ``gate_account`` is whose preferences decide. The row is dropped when ``limit_value`` is
# below the account's option ``limit_key``. ``error`` rejects the row at once,
# ``error_if_sent`` only if the preferences let it through.
_FIELDS = {
    "account": "STRING", "gate_account": "STRING", "gate": "BOOLEAN", "remark": "STRING",
    "link": "STRING", "verified": "BOOLEAN", "limit_key": "STRING", "limit_value": "DOUBLE",
    "error": "STRING", "error_if_sent": "STRING",
}
RECIPIENT = "STRUCT<" + ", ".join(f"{name}: {kind}" for name, kind in _FIELDS.items()) + ">"
NOBODY = f"CAST(array() AS ARRAY<{RECIPIENT}>)"
NO_TEXT = "CAST(NULL AS STRING)"
SEMANTICS = ("reference", "fixed")
AMOUNT = "amount STRING, nai STRING"
# Divisor of an amount that is printed in its own asset.
BY_ASSET = 0
# How a handler names a field of the value.
FIELD = r"\bv\['(\w+)'\]"


@dataclass(frozen=True)
class Handler:
    function: Callable[[str], str]
    amounts: dict[str, int] = field(default_factory=dict)
    nodes: dict[str, str] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    when: str | None = None


_handlers: dict[str, Handler] = {}


def register_handler(
    name: str,
    function: Callable[[str], str],
    amounts: dict[str, int] | None = None,
    nodes: dict[str, str] | None = None,
    computed: dict[str, str] | None = None,
    when: str | None = None,
) -> None:
    """Make ``name`` usable as a hook's function.

    ``amounts`` maps keys of the value that hold an amount to the divisor its text needs
    (``BY_ASSET``: that of its asset). ``nodes`` maps other keys to the fields (DDL) read
    from them. Both may be JSON nodes or JSON inside a string. ``computed`` maps column
    names of the handler's own to expressions over these. ``when`` is a condition over ``v``
    without which the handler has no recipients; where it fails, its nodes are not parsed.
    """
    _handlers[name] = Handler(
        function, dict(amounts or {}), dict(nodes or {}), dict(computed or {}), when
    )


def sql_handler(name: str, parts: dict) -> str:
    """Register a handler given as SQL; gives the name under which hooks call it.

    ``parts`` holds expressions over what a handler reads: ``account`` and any other field of
    RECIPIENT; ``each``, an array of which every element, called ``item``, makes a row (without
    it there is one row); ``where``, a condition on a row. ``amounts``, ``nodes`` and ``computed``
    are those of ``register_handler``. A row whose condition or ``gate`` is NULL is none, and one
    whose account is NULL is a reject. Equal definitions share a name, others do not meet.
    """
    declared = {key: parts.get(key) for key in ("amounts", "nodes", "computed")}
    own = {key: value for key, value in parts.items() if key not in declared}
    unknown = sorted(set(own) - {"each", "where", *_FIELDS})
    if unknown:
        raise ValueError(f"handler {name} gives unknown parts: {unknown}")
    if "account" not in own:
        raise ValueError(f"handler {name} gives no account")
    wrong = sorted(key for key, value in own.items() if not isinstance(value, str) or not value.strip())
    if wrong:
        raise ValueError(f"handler {name}: {wrong} have to be SQL texts")
    digest = hashlib.md5(json.dumps([name, parts], sort_keys=True).encode()).hexdigest()
    key = "".join(c for c in name if c.isalnum() or c == "_") + ":" + digest
    register_handler(key, lambda semantics: _rows(
        own.get("each"), own.get("where", "true"), {k: own[k] for k in _FIELDS if k in own}), **declared)
    return key


def function_handler(spark: SparkSession, name: str) -> Handler:
    """The session's SQL function ``name`` as a handler.

    Its argument is the map ``v``. It returns an array of structs with ``account`` and any other
    fields of RECIPIENT, or the struct of one row; NULL is no recipient.
    """
    shape = spark.sql(f"SELECT {name}(CAST(map() AS MAP<STRING,STRING>)) AS r").schema["r"].dataType
    many = isinstance(shape, ArrayType)
    row = shape.elementType if many else shape
    if not isinstance(row, StructType) or "account" not in row.names or set(row.names) - set(_FIELDS):
        raise ValueError(f"function {name} returns no recipients: {shape.simpleString()}")
    fields = {key: f"item.{key}" for key in row.names}
    called = f"{name}(v)" if many else f"array({name}(v))"
    return Handler(lambda semantics: _rows(called, "item IS NOT NULL", fields))


def _rows(each: str | None, where: str, fields: dict[str, str]) -> str:
    """Recipients of expressions; each is brought to its field's type."""
    typed = {
        key: f"CAST(({value}) AS {_FIELDS[key]})" for key, value in fields.items()
    }
    if "gate" in typed:
        typed["gate"] = f"coalesce({typed['gate']}, false)"
    row = recipient(**{"remark": NO_TEXT, "link": NO_TEXT} | typed)
    if each is None:
        return only_if(f"coalesce({where}, false)", row)
    return f"transform(filter({each}, item -> coalesce({where}, false)), item -> {row})"


def _handler(name: str, **declared):
    def add(function):
        register_handler(name, function, **declared)
        return function

    return add


def _chosen(functions: Iterable[str]) -> dict[str, Handler]:
    chosen, missing = {}, []
    for name in sorted(set(functions)):
        handler = _handlers.get(name) or _of_session(name)
        if handler is None:
            missing.append(name)
        else:
            chosen[name] = handler
    if missing:
        raise ValueError(f"no handler registered for {missing}")
    return chosen


def _of_session(name: str) -> Handler | None:
    spark = SparkSession.getActiveSession()
    known = spark is not None and name.isidentifier() and spark.catalog.functionExists(name)
    return function_handler(spark, name) if known else None


def fields_read(functions: Iterable[str], semantics: str) -> set[str] | None:
    """The fields of a value that the handlers name; None if one may look at any field."""
    names: set[str] = set()
    for handler in _chosen(functions).values():
        names |= {*handler.amounts, *handler.nodes}
        for expression in (handler.function(semantics), *handler.computed.values()):
            names |= set(re.findall(FIELD, expression))
            if re.search(r"\bv\b", re.sub(FIELD, "", expression), re.IGNORECASE):
                return None
    return names


def shapes_read(functions: Iterable[str]) -> dict[str, str]:
    """The types of the fields that the handlers declare as amounts or nodes.

    A field that is declared in two ways has none, and is read from its text.
    """
    declared: dict[str, set[str]] = {}
    for handler in _chosen(functions).values():
        for key, ddl in {**dict.fromkeys(handler.amounts, AMOUNT), **handler.nodes}.items():
            declared.setdefault(key, set()).add(_shape(ddl))
    return {key: min(kinds) for key, kinds in declared.items() if len(kinds) == 1}


def _shape(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString()


def _parsed(key: str, ddl: str, shaped: set[str] | None) -> str:
    """A declared field: from the columns of a landed value as far as there are any, or from its text."""
    if shaped is None:
        return f"v['{key}']"
    read = from_text(f"v['{key}']", _shape(ddl))
    return f"coalesce(shaped.`{key}`, {read})" if key in shaped else read


def _case(subject: str, branches: dict, otherwise: str = "NULL") -> str:
    """CASE over a column; ``otherwise`` alone when there is no branch."""
    if not branches:
        return otherwise
    whens = " ".join(f"WHEN '{name}' THEN {value}" for name, value in branches.items())
    return f"CASE {subject} {whens} ELSE {otherwise} END"


def parse_declared(matched: DataFrame, functions: Iterable[str]) -> DataFrame:
    """Add what the chosen handlers declared: amounts with their texts, and nodes.

    The n-th amounts of all handlers share one column, so there is one parse and one
    text per amount however many handlers there are. Where the log was landed as VARIANT
    (``shaped`` tells), they are read instead of parsed.
    """
    shaped = set(matched.schema["shaped"].dataType.names) if "shaped" in matched.columns else None
    read = "{}" if shaped is not None else "from_json({}, '{}')"
    handlers = _chosen(functions)
    nodes: dict[str, str] = {}
    for name, handler in handlers.items():
        for key, ddl in handler.nodes.items():
            if nodes.setdefault(key, ddl) != ddl:
                raise ValueError(f"handler {name} declares other fields for {key}")
    parsed, divisors, texts = {}, {}, {}
    if nodes:
        parsed["nodes"] = struct(**{
            key: read.format(
                _case("funct", {
                    n: f"IF({h.when}, {_parsed(key, ddl, shaped)}, NULL)" if h.when else _parsed(key, ddl, shaped)
                    for n, h in handlers.items() if key in h.nodes
                }),
                ddl,
            )
            for key, ddl in sorted(nodes.items())
        })
    for slot in range(1, max((len(h.amounts) for h in handlers.values()), default=0) + 1):
        held = {
            name: list(handler.amounts.items())[slot - 1]
            for name, handler in handlers.items()
            if len(handler.amounts) >= slot
        }
        column = f"amount{slot}"
        by_asset = _case(f"{column}.nai", {nai: divisor for nai, (_, divisor) in ASSETS.items()})
        parsed[column] = read.format(
            _case("funct", {name: _parsed(key, AMOUNT, shaped) for name, (key, _) in held.items()}), AMOUNT
        )
        divisors[f"divisor{slot}"] = _case("funct", {
            name: divisor if divisor != BY_ASSET else by_asset
            for name, (_, divisor) in held.items()
        })
        texts[f"shown{slot}"] = amount_text(f"{column}.amount", f"divisor{slot}")
    for name, handler in handlers.items():
        for column, expression in handler.computed.items():
            if column in texts:
                raise ValueError(f"handler {name} computes {column} a second time")
            texts[column] = f"IF(funct = '{name}', {expression}, NULL)"
    for columns in (parsed, divisors, texts):
        if columns:
            matched = matched.selectExpr(
                "*", *[f"{expression} AS {name}" for name, expression in columns.items()]
            )
    return matched


# Whether ``recipient`` puts remarks and links into its rows.
_texts_wanted = True


def recipients(functions: Iterable[str], semantics: str, texts: bool = True) -> Column:
    """The recipients of each (operation, hook), by the hook's function.

    Without ``texts`` remarks and links are NULL, so neither they nor the amounts printed in
    them are made.
    """
    global _texts_wanted
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    _texts_wanted = texts
    try:
        rows = {name: h.function(semantics) for name, h in _chosen(functions).items()}
    finally:
        _texts_wanted = True
    return F.expr(_case("funct", rows, NOBODY))


def recipient(
    account: str, remark: str, link: str, *, gate_account: str | None = None,
    gate: str = "true", verified: str = "true", limit_key: str = NO_TEXT,
    limit_value: str = "CAST(NULL AS DOUBLE)", error: str = NO_TEXT,
    error_if_sent: str = NO_TEXT,
) -> str:
    if not _texts_wanted:
        remark = link = NO_TEXT
    return struct(
        account=account, gate_account=gate_account or account, gate=gate, remark=remark,
        link=link, verified=verified, limit_key=limit_key, limit_value=limit_value,
        error=error, error_if_sent=error_if_sent,
    )


def only_if(condition: str, row: str) -> str:
    return f"IF({condition}, array({row}), {NOBODY})"


def profile_link(name: str) -> str:
    return text(f"'{LINK_BASE}@'", name)


def post_link(author: str, permlink: str) -> str:
    return text(f"'{LINK_BASE}@'", author, "'/'", permlink)


def first_error(*errors: str) -> str:
    return f"coalesce({', '.join(errors)})"


def _longer(size: str, limit: int, what: str) -> str:
    return f"IF({size} > {limit}, '{what} is longer than {limit}', NULL)"


def too_long(limit: int, *keys: str) -> str:
    sizes = [f"length(v['{key}'])" for key in keys]
    longest = f"greatest({', '.join(sizes)})" if len(sizes) > 1 else sizes[0]
    return _longer(longest, limit, " or ".join(keys))


def _unless_cast(raw: str, kind: str, message: str) -> str:
    return f"IF({raw} IS NOT NULL AND try_cast({raw} AS {kind}) IS NULL, '{message}', NULL)"


def not_number(raw: str, what: str) -> str:
    return _unless_cast(raw, "DOUBLE", f"{what} is not a number")


def not_integer(raw: str, what: str) -> str:
    return _unless_cast(raw, "BIGINT", f"{what} is not an integer")


@_handler("core_transfer", amounts={"amount": BY_ASSET})
def transfer(semantics: str) -> str:
    raw, asset = "amount1.amount", "amount1.nai"
    currency = _case(asset, {nai: f"'{name}'" for nai, (name, _) in ASSETS.items()})
    limited = f"{asset} IN ('{ASSET_IDS['HBD']}', '{ASSET_IDS['HIVE']}')"
    overlong = first_error(
        too_long(MAX_ACCOUNT, "from", "to"),
        _longer(f"length({asset})", MAX_ASSET, "asset"),
        too_long(MAX_MEMO, "memo"),
    )
    row = recipient(
        "v['to']",
        text("'you have received '", "shown1", "' '", currency, "' from '", "v['from']"),
        profile_link("v['from']"),
        limit_key=f"IF({limited}, concat('min_', lower({currency})), NULL)",
        limit_value=f"IF({limited}, try_cast({raw} AS DOUBLE) / 1000, NULL)",
        error=first_error(
            overlong, f"IF({currency} IS NOT NULL, {not_number(raw, 'amount')}, NULL)"
        ),
    )
    complete = f"(v['from'] IS NOT NULL AND v['to'] IS NOT NULL AND {asset} IS NOT NULL)"
    return only_if(f"{complete} OR {overlong} IS NOT NULL", row)


@_handler("core_deleg", amounts={"vesting_shares": 1_000_000})
def delegation(semantics: str) -> str:
    raw = "amount1.amount"
    vests = f"CAST(try_cast({raw} AS DECIMAL(19,0)) / 1000000 AS DECIMAL(38,6))"
    given = text("v['delegator']", "' is now delegating '", vests, "' VESTS to you'")
    removed = text("v['delegator']", "' removed their vesting delegation'")
    return "array({})".format(recipient(
        "v['delegatee']",
        f"IF(try_cast({raw} AS BIGINT) > 0, {given}, {removed})",
        profile_link("v['delegator']"),
        error=first_error(
            too_long(MAX_ACCOUNT, "delegator", "delegatee"), not_integer(raw, "amount")
        ),
    ))


PAYOUTS = {"hbd_payout": 1_000, "hive_payout": 1_000, "vesting_payout": 1_000_000}
SHOWN_PAYOUTS = ("shown1", "' HBD, '", "shown2", "' HIVE, '", "shown3", "' VESTS'")


def _wrong_amounts(*keys: str) -> str:
    return first_error(
        *[not_number(f"amount{slot}.amount", key) for slot, key in enumerate(keys, start=1)]
    )


@_handler("core_author_reward", amounts=PAYOUTS)
def author_reward(semantics: str) -> str:
    return "array({})".format(recipient(
        "v['author']",
        text("'You received a reward for your post. '", *SHOWN_PAYOUTS),
        post_link("v['author']", "v['permlink']"),
        error=first_error(too_long(MAX_ACCOUNT, "author"), too_long(MAX_TEXT, "permlink")),
        error_if_sent=_wrong_amounts(*PAYOUTS),
    ))


@_handler("core_comment_benefactor_reward", amounts=PAYOUTS)
def benefactor_reward(semantics: str) -> str:
    return "array({})".format(recipient(
        "v['benefactor']",
        text("'You received a benefactor reward from '", "v['author']", "': '", *SHOWN_PAYOUTS),
        post_link("v['author']", "v['permlink']"),
        error=first_error(
            too_long(MAX_ACCOUNT, "benefactor", "author"), too_long(MAX_TEXT, "permlink")
        ),
        error_if_sent=_wrong_amounts(*PAYOUTS),
    ))


@_handler("core_curation_reward", amounts={"reward": 1_000_000})
def curation_reward(semantics: str) -> str:
    return "array({})".format(recipient(
        "v['curator']",
        text("'You received a curation reward of '", "shown1", "' VESTS'"),
        post_link("v['comment_author']", "v['comment_permlink']"),
        error=too_long(MAX_ACCOUNT, "curator"),
        error_if_sent=_wrong_amounts("reward"),
    ))


@_handler("core_fill_convert_request", amounts={"amount_in": 1_000, "amount_out": 1_000})
def conversion(semantics: str) -> str:
    # The established texts name the two currencies the wrong way round.
    hive_first = f"amount1.nai <=> '{HBD}'"
    if semantics == "fixed":
        hive_first = f"NOT ({hive_first})"
    to_hbd = text("'Successfully converted '", "shown1", "' HIVE to '", "shown2", "' HBD'")
    to_hive = text("'Successfully converted '", "shown1", "' HBD to '", "shown2", "' HIVE'")
    return "array({})".format(recipient(
        "v['owner']", f"IF({hive_first}, {to_hbd}, {to_hive})", profile_link("v['owner']"),
        error=too_long(MAX_ACCOUNT, "owner"),
        error_if_sent=_wrong_amounts("amount_in", "amount_out"),
    ))


def vote_value(weight: str, total: str, payout: str) -> str:
    """Dollar value of a vote with two decimals: 0 if a part is 0, NULL if one is missing."""
    share = f"try_divide(CAST({weight} AS DOUBLE), CAST({total} AS DOUBLE))"
    dollars = f"{share} * CAST({payout} AS DOUBLE) / 1000"
    return (
        f"IF({weight} = 0 OR {total} = 0 OR {payout} = 0, CAST(0 AS DECIMAL(10,2)), "
        f"{cents_of_float(dollars)})"
    )


VOTE = {
    "weight": "v['weight']", "total_vote_weight": "v['total_vote_weight']",
    "pending_payout": "amount1.amount",
}
VOTE_PARTS = [f"try_cast({raw} AS BIGINT)" for raw in VOTE.values()]


@_handler(
    "core_vote", amounts={"pending_payout": 1_000},
    computed={"vote_dollars": vote_value(*VOTE_PARTS)},
)
def vote(semantics: str) -> str:
    all_known = " AND ".join(f"{part} IS NOT NULL" for part in VOTE_PARTS)
    return "array({})".format(recipient(
        "v['author']",
        text("v['voter']", "' voted on your post ($'", "CAST(vote_dollars AS STRING)", "')'"),
        post_link("v['author']", "v['permlink']"),
        gate="coalesce(vote_dollars > 0.01BD, false)",
        error=first_error(
            too_long(MAX_ACCOUNT, "voter", "author"), too_long(MAX_TEXT, "permlink"),
            *[not_integer(raw, name) for name, raw in VOTE.items()],
            f"IF(vote_dollars IS NULL AND {all_known}, 'value is out of range', NULL)",
        ),
    ))


IS_REPLY = "coalesce(length(v['parent_author']) > 0 AND length(v['parent_permlink']) > 0, false)"


def _comment_errors() -> str:
    return first_error(
        too_long(MAX_ACCOUNT, "parent_author", "author"),
        too_long(MAX_TEXT, "parent_permlink", "permlink"),
    )


@_handler("core_comment")
def comment(semantics: str) -> str:
    # The established rule stores the row for the commenter and names the parent author.
    to, named = "v['author']", "v['parent_author']"
    if semantics == "fixed":
        to, named = named, to
    row = recipient(
        to, text(named, "' commented on your post'"), post_link("v['author']", "v['permlink']"),
        gate_account="v['parent_author']", error=_comment_errors(),
    )
    return only_if(f"{IS_REPLY} OR {_comment_errors()} IS NOT NULL", row)


@_handler("core_mention")
def mention(semantics: str) -> str:
    error = _comment_errors()
    remark = text("v['author']", "' mentioned you in a '", f"IF({IS_REPLY}, 'comment', 'post')")
    own = post_link("v['author']", "v['permlink']")
    parent = post_link("v['parent_author']", "v['parent_permlink']")
    in_reply = text(parent, "'#@'", "v['author']", "'/'", "v['permlink']")
    link = f"IF({IS_REPLY}, {in_reply}, {own})"
    body = "v['body']"
    names = f"array_except({mentioned_names(body)}, array(v['author']))"
    rows = f"transform({names}, name -> {recipient('name', remark, link)})"
    failed = recipient("v['author']", remark, link, error=error)
    return f"IF({error} IS NOT NULL, array({failed}), coalesce({rows}, {NOBODY}))"


IS_TOKEN_TRANSFER = f"v['id'] = '{TOKEN_TRANSFER_ID}'"


# Other custom operations are many, and parsing their arrays as an object throws inside Spark.
@_handler(
    "sm_token_transfer", nodes={"json": "`to` STRING, qty STRING, token STRING, memo STRING"},
    when=IS_TOKEN_TRANSFER,
)
def token_transfer(semantics: str) -> str:
    to, qty, token = "nodes.json.to", "nodes.json.qty", "nodes.json.token"
    sender = first_element("v['required_auths']")
    shown = float_text(f"try_cast({qty} AS DOUBLE)")
    row = recipient(
        to,
        text("'you have received '", shown, "' '", token, "' from '", sender),
        profile_link(sender),
        verified="CAST(NULL AS BOOLEAN)",
        error=first_error(
            _longer(f"length({sender})", MAX_ACCOUNT, "sender"),
            not_number(qty, "qty"),
            _longer(f"length({token})", MAX_ASSET, "token"),
            _longer("length(nodes.json.memo)", MAX_MEMO, "memo"),
        ),
    )
    return only_if(f"{IS_TOKEN_TRANSFER} AND {to} IS NOT NULL", row)
