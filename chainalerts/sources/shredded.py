"""A log whose bodies are landed as shredded VARIANT: readers take single fields from columns.

Each operation is parsed once, when it lands. ``val`` holds the body's ``value``; as the files of one
directory hold operations of one type, Spark finds that type's fields and lays each out as a
column of its own. A plan over such a log asks for the fields that its rules name; the scan reads these
columns and nothing parses a body again.

    write_shredded(ops, path)
    AlertPlan(scan_ops(read_shredded(spark, path), first, last), ...)

What is read is what the text log gives. Where a variant would show a value in another way (a
repeated key, of which the first counts), ``val`` holds the text of every field instead. Two things
differ: the keys of a node inside a body come in alphabetical order, and ``typed_ops`` takes a number
or a node that was written as a string for what it says, as the handlers do. A malformed body has no ``val``. The text stays in
``body``, which only the payloads of notifications read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from chainalerts import schemas
from chainalerts.functions.json_values import fenced, value_map
from chainalerts.sources.op_log import BLOCK_BUCKET, in_directories

SETTINGS = {
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
}
# The first entry of each key, as looking up a key finds it.
FIRST_OF_KEYS = "map_from_entries(filter(map_entries(v), (e, i) -> array_position(map_keys(v), e.key) = i + 1))"
SHOWS_THE_SAME = """size(v) <=> size(shown) AND forall(map_entries(v), e ->
    shown[e.key] <=> e.value OR (substr(e.value, 1, 1) IN ('{', '[') AND shown[e.key] IS NOT NULL))"""


def with_variant(ops: DataFrame) -> DataFrame:
    """Add ``val``, the body's value as a VARIANT."""
    parsed = fenced(ops, v=value_map(), parsed="try_variant_get(try_parse_json(body), '$.value', 'variant')")
    shown = fenced(parsed, shown="try_variant_get(parsed, '$', 'map<string,string>')")
    return shown.selectExpr(*ops.columns, f"""CASE WHEN v IS NULL THEN NULL
        WHEN {SHOWS_THE_SAME} THEN parsed ELSE to_variant_object({FIRST_OF_KEYS}) END AS val""")


def write_shredded(ops: DataFrame, path: str, bucket: int = BLOCK_BUCKET) -> None:
    """Land a log: directories by block bucket and operation type, files sorted by block."""
    dealt = (
        in_directories(with_variant(ops), bucket)
        .hint("rebalance", "bucket_first", "op_type_id")
        .sortWithinPartitions("bucket_first", "op_type_id", "block_num", "op_id")
    )
    with _settings(ops.sparkSession):
        (dealt.write.partitionBy("bucket_first", "bucket_last", "op_type_id")
         .mode("overwrite").parquet(path))


def read_shredded(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``val``; a range and types prune directories."""
    return spark.read.schema(f"{schemas.OPS}, val VARIANT, bucket_first INT, bucket_last INT").parquet(path)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Shredding is switched on for one write; the session's own settings come back."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
