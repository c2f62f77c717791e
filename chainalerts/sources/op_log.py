"""Reading the ordered operation log and the transactions that carry it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from chainalerts import schemas
from chainalerts.constants import OP_CUSTOM_JSON, OP_TRANSFER, START_DISTANCE_BLOCKS
from chainalerts.functions.json_values import (
    fenced, from_text, node, value_field, value_fields, value_map,
)

BLOCK_BUCKET = 100_000


def write_ops(ops: DataFrame, path: str, bucket: int = BLOCK_BUCKET) -> None:
    """Land a log: one directory per block bucket, files sorted for min/max skipping.

    A directory is named by its bucket's first and last block, so a reader needs to know
    nothing of ``bucket``, and logs landed with different sizes can lie side by side.
    """
    (
        in_directories(ops, bucket)
        .hint("rebalance", "bucket_first")
        .sortWithinPartitions("bucket_first", "op_type_id", "block_num", "op_id")
        .write.partitionBy("bucket_first", "bucket_last")
        .mode("overwrite")
        .parquet(path)
    )


def in_directories(rows: DataFrame, bucket: int) -> DataFrame:
    """Add the first and last block of each row's block bucket, by which directories are named."""
    first = F.floor(F.col("block_num") / F.lit(bucket)) * bucket
    return rows.withColumn("bucket_first", first.cast("int")).withColumn(
        "bucket_last", (first + (bucket - 1)).cast("int"))


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPS + ", bucket_first INT, bucket_last INT").parquet(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


def scan_ops(ops: DataFrame, first: int, last: int) -> DataFrame:
    """Operations of blocks ``first..last``, both ends included.

    Over a landed log whole directories are pruned by the blocks in their names. The
    order stays a key (block_num, op_id); nothing is sorted here.
    """
    picked = ops.where(F.col("block_num").between(first, last))
    if "bucket_first" in ops.columns:
        picked = picked.where((F.col("bucket_first") <= last) & (F.col("bucket_last") >= first))
    return picked


def ops_of_types(
    ops: DataFrame, type_ids: Iterable[int], lower: int, upper: int
) -> DataFrame:
    """Operations of the given types with ``lower <= op_id <= upper``."""
    return ops.where(
        F.col("op_type_id").isin(list(type_ids)) & F.col("op_id").between(lower, upper)
    )


def final_ops(ops: DataFrame, irreversible_block: int) -> DataFrame:
    """The finality gate: never read above the last irreversible block."""
    return ops.where(F.col("block_num") <= irreversible_block)


def typed_ops(ops: DataFrame, op_type_id: int) -> DataFrame:
    """Operations of one documented type with the body's fields as typed columns.

    A malformed body or one of another shape gives NULL fields. Of a log that was landed as
    VARIANT, the columns of the fields are read, and a number or a node that was
    written as a string counts as what it says.
    """
    name, value_schema = schemas.OPERATIONS[op_type_id]
    places = ["op_id", "block_num", "ts", "trx_in_block"]
    if "val" in ops.columns:
        fields = [f"{_typed(field.name, field.dataType)} AS `{field.name}`" for field in StructType.fromDDL(value_schema)]
        return ops.where(F.col("op_type_id") == op_type_id).selectExpr(
            *places, f"'{name}' AS op_name", *fields)
    parsed = F.from_json("body", f"type STRING, value STRUCT<{_as_struct(value_schema)}>")
    return (
        ops.where(F.col("op_type_id") == op_type_id)
        .withColumn("parsed", parsed)
        .select(*places, F.lit(name).alias("op_name"), F.col("parsed.value.*"))
    )


def _typed(name: str, kind: DataType) -> str:
    read = value_field(name, kind.simpleString())
    if not isinstance(kind, (ArrayType, StructType)):
        return read
    return f"coalesce({read}, {from_text(value_field(name, 'string'), kind.simpleString())})"


def documented_ops(ops: DataFrame, shown: dict[int, tuple[str, str | None]]) -> DataFrame:
    """Operations of many documented types in one scan, each body parsed once.

    ``shown`` names per type a text field and an amount field (or None): they become
    ``actor`` and ``amount`` (the raw integer). ``n_fields`` counts the documented fields
    that are there. What differs by type is a lookup by the operation's type.
    """
    def by_type(values: dict, kind: str) -> str:
        whens = " ".join(
            f"WHEN {op} THEN {value}" for op, value in values.items() if value is not None
        )
        return f"CASE op_type_id {whens} END" if whens else f"CAST(NULL AS {kind})"

    names, keys, actors, amounts = {}, {}, {}, {}
    for op, (actor, amount) in shown.items():
        name, ddl = schemas.OPERATIONS[op]
        fields = ", ".join(f"'{field}'" for field in _field_names(ddl))
        names[op], keys[op] = f"'{name}'", f"array({fields})"
        actors[op] = f"v['{actor}']"
        amounts[op] = f"v['{amount}']" if amount else None
    picked = _with_values(ops.where(F.col("op_type_id").isin(list(shown))))
    found = f"size(map_filter(v, (k, x) -> x IS NOT NULL AND array_contains({by_type(keys, 'ARRAY<STRING>')}, k)))"
    return picked.selectExpr(
        "op_id", "block_num", f"{by_type(names, 'STRING')} AS op_name",
        f"CAST({found} AS BIGINT) AS n_fields", f"{by_type(actors, 'STRING')} AS actor",
        f"try_cast({node(by_type(amounts, 'STRING'), 'amount')} AS BIGINT) AS amount",
    )


def _field_names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def _as_struct(ddl: str) -> str:
    """``a INT, b STRING`` as the inside of ``STRUCT<...>``."""
    return ", ".join(
        f"`{field.name}`: {field.dataType.simpleString()}" for field in StructType.fromDDL(ddl)
    )


def with_transactions(ops: DataFrame, transactions: DataFrame) -> DataFrame:
    """Attach ``trx_hash``; operations outside any transaction keep NULL."""
    return ops.join(transactions, ["block_num", "trx_in_block"], "left")


def parse_values(
    ops: DataFrame, fields: Iterable[str] | None = None, shapes: dict[str, str] | None = None,
) -> DataFrame:
    """Parse each body once; handlers read the map ``v``.

    Of a log that was landed as VARIANT nothing is parsed: ``v`` holds ``fields`` (all, if None), and
    ``shaped`` those fields that ``shapes`` gives a type.
    """
    if "val" not in ops.columns:
        return ops.withColumn("v", F.expr(value_map()))
    read = {"v": value_fields(fields)}
    if shapes:
        members = ", ".join(f"'{name}', {value_field(name, kind)}" for name, kind in sorted(shapes.items()))
        read["shaped"] = f"named_struct({members})"
    return ops.selectExpr(
        *[name for name in ops.columns if name != "val"], *[f"{value} AS {name}" for name, value in read.items()])


def _with_values(ops: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Add ``v`` for filters; bodies that have to be parsed are parsed once for all of them."""
    return parse_values(ops, fields) if "val" in ops.columns else fenced(ops, v=value_map())


def preference_ops(ops: DataFrame, preference_id: str) -> DataFrame:
    """custom_json operations with the preference id; the type test reaches the scan.

    The id is compared after parsing: in the raw text it may be written with escapes.
    """
    fields = ("id", "json", "required_posting_auths")
    return _with_values(ops.where(F.col("op_type_id") == OP_CUSTOM_JSON), fields).where(
        F.col("v")["id"] == preference_id
    )


def filter_operations(ops: DataFrame, first: int, last: int, wanted: dict[str, str]) -> DataFrame:
    """Range scan plus equality on fields of the body.

    Transfers take ``from`` or else ``to``; custom_json takes ``id``.
    """
    kinds = []
    value = F.expr(value_fields(("from", "to", "id")) if "val" in ops.columns else value_map())
    sender_or_recipient = next((key for key in ("from", "to") if key in wanted), None)
    if sender_or_recipient:
        kinds.append(
            (F.col("op_type_id") == OP_TRANSFER)
            & (value[sender_or_recipient] == wanted[sender_or_recipient])
        )
    if "id" in wanted:
        kinds.append((F.col("op_type_id") == OP_CUSTOM_JSON) & (value["id"] == wanted["id"]))
    picked = scan_ops(ops, first, last)
    if not kinds:
        return picked.where(F.col("op_type_id").isin(OP_TRANSFER, OP_CUSTOM_JSON))
    condition = kinds[0]
    for other in kinds[1:]:
        condition = condition | other
    return picked.where(condition)


def operation_family(op_type_id: Column) -> Column:
    return F.when(op_type_id == OP_CUSTOM_JSON, "custom_json").when(op_type_id == OP_TRANSFER, "transfer")


def log_heads(ops: DataFrame) -> DataFrame:
    """Head block and head operation id, as one row."""
    return ops.agg(
        F.max("block_num").alias("head_block"), F.max("op_id").alias("head_op_id")
    )


def first_op_of_blocks(ops: DataFrame) -> DataFrame:
    """First operation id of every block."""
    return ops.groupBy("block_num").agg(F.min("op_id").alias("first_op_id"))


def first_op_of_block(ops: DataFrame, block_num: int) -> DataFrame:
    return ops.where(F.col("block_num") == block_num).agg(
        F.min("op_id").alias("first_op_id")
    )


def start_block(irreversible_block: int) -> int:
    """Where a fresh sync starts: seven days of blocks before the final one."""
    return irreversible_block - START_DISTANCE_BLOCKS


def block_ranges(spark: SparkSession, first: int, last: int, size: int) -> DataFrame:
    """Split ``first..last`` into ranges, one row each, made in parallel.

    The first range holds size + 1 values, later ones ``size``; the last one is cut.
    """
    count = max(-(-(last - first) // size), 1)
    n, size_ = F.col("id"), F.lit(size)
    return spark.range(1, count + 1).select(
        F.when(n == 1, F.lit(first)).otherwise(F.lit(first) + (n - 1) * size_ + 1)
        .cast("bigint").alias("range_first"),
        F.least(F.lit(first) + n * size_, F.lit(last)).cast("bigint").alias("range_last"),
    )


def range_of_block(block_num: Column, first: int, size: int) -> Column:
    """First block of the range (as ``block_ranges`` makes them) that a block lies in."""
    n = F.greatest(F.ceil((block_num - F.lit(first)) / F.lit(size)), F.lit(1))
    return F.when(n == 1, F.lit(first)).otherwise(F.lit(first) + (n - 1) * size + 1).cast("bigint")
