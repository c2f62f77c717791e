"""The preference log: which preference operations count, and what they set.

Everything here is row-local (no shuffle): the rule catalog is a folded literal, so an
operation is validated as a whole before it is exploded to history rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.constants import ALL_CODES, MAX_ACCOUNT, PREFERENCE_ID
from chainalerts.functions.json_values import (
    fenced, first_element, json_type, object_entries, struct, variant_at,
)
from chainalerts.operators.hooks import Catalog, literal
from chainalerts.sources.op_log import preference_ops


def envelope(values: DataFrame) -> DataFrame:
    """Add ``doc``, ``op_name``, ``data``, ``valid`` and ``effective``.

    ``valid``: [[number, string], name, object], or an object (it passes, and does
    nothing). ``effective``: valid, a known name, and the third element is there.
    """
    name, data = variant_at("doc", "$[1]"), variant_at("doc", "$[2]")
    parsed = fenced(
        values, doc="try_parse_json(v['json'])", items="json_array_length(v['json'])"
    )
    looked = fenced(
        parsed,
        doc_type=json_type("doc"),
        header="try_variant_get(doc, '$[0]', 'array<variant>')",
        name_type=json_type(name),
        op_name=f"IF({json_type(name)} = 'string', try_variant_get(doc, '$[1]', 'string'), NULL)",
        data=data,
        data_type=json_type(data),
    )
    shape_ok = (
        "items >= 1 AND size(header) = 2 "
        f"AND {json_type('try_element_at(header, 1)')} = 'number' "
        f"AND {json_type('try_element_at(header, 2)')} = 'string' "
        "AND (items < 2 OR name_type = 'string') AND (items < 3 OR data_type = 'object')"
    )
    valid = f"coalesce(doc_type = 'object' OR (doc_type = 'array' AND {shape_ok}), false)"
    known = "op_name IN ('enabled', 'options') AND data_type = 'object'"
    return (
        fenced(looked, valid=valid)
        .selectExpr("*", f"valid AND coalesce({known}, false) AS effective")
        .drop("header", "items", "name_type", "data_type", "doc_type")
    )


def _enabled_entries(codes: str) -> str:
    """Modules of an ``enabled`` operation with ``*`` replaced by the module's codes."""
    listed = "try_variant_get(entry.value, '$', 'array<string>')"
    known = f"{codes}[entry.key]"
    starred = f"coalesce(array_contains({listed}, '{ALL_CODES}'), false)"
    not_a_list = f"NOT coalesce({json_type('entry.value')} = 'array', false)"
    no_codes = "CAST(array() AS ARRAY<STRING>)"
    each_known = (
        f"forall({listed}, code -> coalesce(array_contains(coalesce({known}, {no_codes}), code), "
        "false))"
    )
    row = struct(
        module="entry.key",
        codes=f"IF({starred}, {known}, {listed})",
        # Not a list, or ``*`` of an unknown module.
        broken=f"{not_a_list} OR ({starred} AND {known} IS NULL)",
        known=f"coalesce({starred} OR {each_known}, false)",
    )
    return f"transform({object_entries('data')}, entry -> {row})"


def _option_entries(types: str) -> str:
    """Modules of an ``options`` operation, checked against the hooks' declared types."""
    codes = object_entries("entry.value")
    wanted = f"{types}[entry.key][code.key]"
    option_ok = f"coalesce({json_type('option.value')} = {wanted}[option.key], false)"
    code_ok = (
        f"coalesce({wanted} IS NOT NULL AND "
        f"forall({object_entries('code.value')}, option -> {option_ok}), false)"
    )
    bad_code = f"{wanted} IS NOT NULL AND {json_type('code.value')} <> 'object'"
    row = struct(
        module="entry.key",
        broken=f"coalesce({json_type('entry.value')} <> 'object', true) "
               f"OR coalesce(exists({codes}, code -> {bad_code}), false)",
        known=f"coalesce(forall({codes}, code -> {code_ok}), false)",
    )
    return f"transform({object_entries('data')}, entry -> {row})"


def preference_log(ops: DataFrame, catalog: Catalog) -> DataFrame:
    """Every preference operation with its verdict.

    ``outcome`` is one of: accepted; invalid (envelope); none (valid, no effect);
    rejected (a pair or option is not known); broken (an error: see ``reason``).
    """
    codes = literal(catalog.codes(), "map<string,array<string>>")
    types = literal(catalog.option_types(), "map<string,map<string,map<string,string>>>")
    checked = fenced(
        envelope(preference_ops(ops, PREFERENCE_ID)),
        account=first_element("v['required_posting_auths']"),
        enabled=f"IF(effective AND op_name = 'enabled', {_enabled_entries(codes)}, NULL)",
        options=f"IF(effective AND op_name = 'options', {_option_entries(types)}, NULL)",
    )
    judged = fenced(
        checked,
        reason=f"""CASE
            WHEN v['json'] IS NOT NULL AND doc IS NULL THEN 'malformed json'
            WHEN length(account) > {MAX_ACCOUNT} THEN 'account is longer than {MAX_ACCOUNT}'
            WHEN effective AND account IS NULL THEN 'no posting authority'
            WHEN effective AND coalesce(
                exists(enabled, e -> e.broken), exists(options, e -> e.broken), false)
            THEN 'malformed preference data' END""",
        all_known="coalesce(forall(enabled, e -> e.known), forall(options, e -> e.known), false)",
    )
    return judged.selectExpr(
        "op_id", "block_num", "ts", "account", "op_name", "valid", "effective",
        """CASE WHEN reason IS NOT NULL THEN 'broken' WHEN NOT valid THEN 'invalid'
           WHEN NOT effective THEN 'none' WHEN all_known THEN 'accepted'
           ELSE 'rejected' END AS outcome""",
        "reason",
        "transform(enabled, e -> named_struct('module', e.module, 'codes', e.codes)) AS enabled",
        "IF(op_name = 'options', to_json(data), NULL) AS options",
    )


def pref_history(log: DataFrame) -> DataFrame:
    """Accepted ``enabled`` operations, one row per module they name."""
    return (
        log.where((F.col("outcome") == "accepted") & (F.col("op_name") == "enabled"))
        .select("account", F.explode("enabled").alias("e"), "ts", "block_num", "op_id")
        .select("account", "e.module", "e.codes", F.col("ts").alias("created"),
                "block_num", "op_id")
    )


def option_history(log: DataFrame) -> DataFrame:
    """Accepted ``options`` operations; each replaces the whole document."""
    return log.where(
        (F.col("outcome") == "accepted") & (F.col("op_name") == "options")
    ).select("account", "options", F.col("ts").alias("created"), "block_num", "op_id")


OPTION_DOCUMENT = "map<string,map<string,map<string,string>>>"


def state_changes(log: DataFrame, modules: list[str]) -> DataFrame:
    """Both histories on one key (account, module), for the as-of lookup, in one pass.

    An ``options`` operation replaces the document, so it sets every module: those it
    does not name get an empty map, which hides earlier options.
    """
    opts, codes = "MAP<STRING,MAP<STRING,STRING>>", "ARRAY<STRING>"
    names = ", ".join(f"'{name}'" for name in modules)
    enabled = struct(module="e.module", codes="e.codes", opts=f"CAST(NULL AS {opts})")
    replaced = struct(
        module="m", codes=f"CAST(NULL AS {codes})", opts=f"coalesce(doc[m], CAST(map() AS {opts}))"
    )
    read = fenced(
        log.where(F.col("outcome") == "accepted"),
        doc=f"IF(op_name = 'options', from_json(options, '{OPTION_DOCUMENT}'), NULL)",
    )
    return read.selectExpr(
        "account", "block_num", "op_id",
        f"inline(IF(op_name = 'enabled', transform(enabled, e -> {enabled}), "
        f"transform(array({names}), m -> {replaced})))",
    ).select("account", "module", "codes", "opts", "block_num", "op_id")
