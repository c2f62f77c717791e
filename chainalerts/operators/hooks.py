"""The rule catalog: hooks, modules, dispatch of operations to hooks.

A catalog is configuration read from a few files, so the driver holds it. Its frames are
local rows of a known size; how they travel is left to Spark.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from chainalerts import schemas
from chainalerts.constants import MODULE_PATTERN, PREFERENCE_FUNCTION, RULES
from chainalerts.operators.handlers import sql_handler


@dataclass(frozen=True)
class Hook:
    module: str
    notif_name: str
    notif_code: str
    description: str
    funct: str
    op_id: int
    notif_filter: str = ""
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    """Modules as name -> (category, enabled), and their hooks."""

    modules: dict[str, tuple[str, bool]]
    hooks: tuple[Hook, ...]

    @classmethod
    def default(cls) -> Catalog:
        return cls({}, ()).register(RULES)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        """Read ``<path>/<module>/hooks.json`` files; other directory names are skipped."""
        files = spark.read.text(f"{path}/*/hooks.json", wholetext=True).select(
            F.regexp_extract(F.input_file_name(), r"([^/]+)/hooks\.json$", 1).alias("module"),
            F.col("value"),
        )
        rows = files.where(F.col("module").rlike(MODULE_PATTERN)).orderBy("module").collect()
        return cls({}, ()).register({row["module"]: json.loads(row["value"]) for row in rows})

    def register(self, rules: dict[str, dict]) -> Catalog:
        """Insert or update hooks by (module, notif_name).

        An update of a known module changes its flag and its hooks, not its category. A hook
        names its handler as ``function``; with ``sql`` it brings the handler along.
        """
        modules = dict(self.modules)
        hooks = {(hook.module, hook.notif_name): hook for hook in self.hooks}
        for module, entries in rules.items():
            if not re.match(MODULE_PATTERN, module):
                raise ValueError(f"invalid module name: {module}")
            category = modules.get(module, (entries["module_category"], True))[0]
            modules[module] = (category, bool(entries["enabled"]))
            for name, entry in entries.items():
                if name in ("enabled", "module_category"):
                    continue
                function = entry["function"].rsplit(".", 1)[-1]
                if "sql" in entry:
                    function = sql_handler(function, entry["sql"])
                hooks[module, name] = Hook(
                    module, name, entry["notif_code"], entry["description"],
                    function, int(entry["op_id"]),
                    _filter_text(entry.get("filter", "")), dict(entry.get("options", {})),
                )
        return Catalog(modules, tuple(hooks[key] for key in sorted(hooks)))

    def merged(self, other: Catalog) -> Catalog:
        """Both catalogs' modules and hooks; of equal keys those of ``other``."""
        hooks = {(hook.module, hook.notif_name): hook for hook in self.hooks + other.hooks}
        return Catalog(self.modules | other.modules, tuple(hooks[key] for key in sorted(hooks)))

    def set_enabled(self, module: str, enabled: bool) -> Catalog:
        if module not in self.modules:
            raise ValueError(f"unknown module: {module}")
        modules = dict(self.modules)
        modules[module] = (modules[module][0], enabled)
        return replace(self, modules=modules)

    def is_enabled(self, module: str) -> bool | None:
        return self.modules[module][1] if module in self.modules else None

    def module_list(self) -> list[str]:
        """Modules a user can ask for."""
        return [module for module in sorted(self.modules) if module != "core"]

    def ordered(self) -> list[tuple[int, Hook]]:
        """Hooks with their order within one operation."""
        return list(enumerate(self.hooks, start=1))

    def enabled_hooks(self) -> list[tuple[int, Hook]]:
        return [(order, hook) for order, hook in self.ordered() if self.is_enabled(hook.module)]

    def notifying_hooks(self) -> list[tuple[int, Hook]]:
        """Enabled hooks that notify, that is all but the preference hook."""
        return [item for item in self.enabled_hooks() if item[1].funct != PREFERENCE_FUNCTION]

    def preference_order(self) -> int | None:
        """Order of the preference hook, None when it is off."""
        return next(
            (order for order, hook in self.enabled_hooks() if hook.funct == PREFERENCE_FUNCTION),
            None,
        )

    def codes(self) -> dict[str, list[str]]:
        """Codes by module, of enabled and disabled modules alike."""
        known: dict[str, list[str]] = {}
        for hook in self.hooks:
            codes = known.setdefault(hook.module, [])
            if hook.notif_code not in codes:
                codes.append(hook.notif_code)
        return known

    def option_types(self) -> dict[str, dict[str, dict[str, str]]]:
        """module -> code -> option name -> JSON type."""
        types: dict[str, dict[str, dict[str, str]]] = {}
        for hook in self.hooks:
            types.setdefault(hook.module, {}).setdefault(hook.notif_code, dict(hook.options))
        return types

    def pairs_of_category(self, category: str) -> list[tuple[str, str]]:
        """Pairs of a category; of equal descriptions the last one counts."""
        by_description = {
            hook.description: (hook.module, hook.notif_code)
            for hook in self.hooks
            if hook.module != "core" and self.modules[hook.module][0] == category
        }
        if not by_description:
            known = sorted({entry[0] for name, entry in self.modules.items() if name != "core"})
            raise ValueError(f"unknown category: {category}; known: {known}")
        return sorted(set(by_description.values()))

    def hooks_frame(self, spark: SparkSession, hooks=None) -> DataFrame:
        chosen = self.ordered() if hooks is None else hooks
        rows = [
            (h.module, h.notif_name, h.notif_code, h.description, h.funct, h.op_id,
             h.notif_filter, h.options, order)
            for order, h in chosen
        ]
        return local_frame(spark, rows, schemas.HOOKS)

    def modules_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, entry[0], entry[1]) for name, entry in sorted(self.modules.items())]
        return local_frame(spark, rows, schemas.MODULES)


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Driver-held rows as a relation whose size Spark knows.

    Of a frame made from a list it knows nothing and takes it for endless: it would shuffle the
    whole log by operation type to meet a few rules.
    """
    schema = StructType.fromDDL(ddl)
    columns = [
        pa.array([list(cell.items()) if isinstance(cell, dict) else cell for cell in cells], to_arrow_type(field.dataType))
        for field, cells in zip(schema, zip(*rows) if rows else [()] * len(schema), strict=True)
    ]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def _filter_text(rule) -> str:
    if isinstance(rule, dict):
        return json.dumps(rule) if rule else ""
    return rule or ""


def literal(value, ddl: str) -> str:
    """A driver-held constant as an expression; the optimizer folds it."""
    text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{ddl}')"


# A hook's filter is a JSON map of body field -> required text; empty passes.
PASSES_FILTER = (
    "length(notif_filter) = 0 OR coalesce(forall(map_entries(from_json(notif_filter, "
    "'map<string,string>')), wanted -> v[wanted.key] <=> wanted.value), false)"
)


def filter_index(rules: DataFrame) -> DataFrame:
    """Rules with the one pair (``on_key``, ``on_value``) of their filter under which they are
    looked up: that which the fewest rules of their type ask for.

    Without a filter, or one that only asks for fields that are not there, the pair is NULL:
    such a rule concerns every operation of its type. A filter that is no map passes nothing,
    and its rule is left out.
    """
    wanted = F.from_json("notif_filter", "map<string,string>")
    wanted = F.when(F.length("notif_filter") == 0, F.create_map().cast("map<string,string>")).otherwise(wanted)
    asked = F.map_filter(wanted, lambda _, value: value.isNotNull())
    pairs = rules.where(wanted.isNotNull()).select("*", F.explode_outer(asked).alias("on_key", "on_value"))
    rarity = F.count("*").over(Window.partitionBy("op_type_id", "on_key", "on_value"))
    least = Window.partitionBy("hook_ord").orderBy("rarity", "on_key")
    return (
        pairs.withColumn("rarity", rarity).withColumn("n", F.row_number().over(least))
        .where("n = 1").drop("rarity", "n")
    )


def dispatch(values: DataFrame, catalog: Catalog, hooks=None) -> DataFrame:
    """Parsed operations x hooks of their type whose filter passes.

    The wanted types go into the scan as a list, before anything else happens. Where hooks have
    filters, an operation meets those that are looked up by one of its fields, and those
    without a filter: it costs by its matches, however many hooks there are.
    """
    chosen = catalog.notifying_hooks() if hooks is None else hooks
    types = sorted({hook.op_id for _, hook in chosen})
    rules = catalog.hooks_frame(values.sparkSession, chosen).selectExpr(
        "module", "notif_name", "notif_code", "funct", "op_id AS op_type_id", "notif_filter",
        "hook_ord",
    )
    wanted = values.where(F.col("op_type_id").isin(types))
    keys = filter_keys(chosen)
    if not keys and not any(hook.notif_filter for _, hook in chosen):
        return wanted.join(rules, "op_type_id")
    known = literal(keys, "map<string,map<string,boolean>>")
    entry = "STRUCT<on_key: STRING, on_value: STRING>"
    looked = wanted.selectExpr("*", f"""inline(concat(
        array(CAST(NULL AS {entry})),
        coalesce(transform(map_entries(map_filter(v, (k, x) -> x IS NOT NULL
            AND coalesce({known}[CAST(op_type_id AS STRING)][k], false))),
            e -> CAST(named_struct('on_key', e.key, 'on_value', e.value) AS {entry})),
            CAST(array() AS ARRAY<{entry}>))))""")
    index = filter_index(rules)
    same = (
        (looked["op_type_id"] == index["op_type_id"])
        & looked["on_key"].eqNullSafe(index["on_key"])
        & looked["on_value"].eqNullSafe(index["on_value"])
    )
    found = looked.join(index, same).where(PASSES_FILTER)
    return found.select(
        *[looked[name] for name in values.columns],
        *[index[name] for name in rules.columns if name != "op_type_id"],
    )


def filter_keys(chosen) -> dict[str, dict[str, bool]]:
    """The fields that filters ask for, by operation type."""
    keys: dict[str, dict[str, bool]] = {}
    for _, hook in chosen:
        try:
            asked = json.loads(hook.notif_filter or "{}")
        except ValueError:
            continue
        if isinstance(asked, dict):
            keys.setdefault(str(hook.op_id), {}).update(dict.fromkeys(asked, True))
    return {op: asked for op, asked in keys.items() if asked}


def upsert_hooks(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Keyed upsert of hook frames: a loaded hook replaces the stored one of its key."""
    key = ["module", "notif_name"]
    return stored.join(loaded, key, "left_anti").unionByName(loaded)


def hooks_with_category(hooks: DataFrame, modules: DataFrame) -> DataFrame:
    return hooks.join(modules, "module")


def module_catalog(hooks: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module except core: its entries [category, description, module, code]."""
    entry = F.struct("module_category", "description", "module", "notif_code")
    return (
        hooks_with_category(hooks, modules)
        .where(F.col("module") != "core")
        .groupBy("module")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )


def category_catalog(hooks: DataFrame, modules: DataFrame) -> DataFrame:
    """Category -> {description: ``module:code``}; of equal descriptions the last wins."""
    pair = F.concat_ws(":", "module", "notif_code")
    return (
        hooks_with_category(hooks, modules)
        .where(F.col("module") != "core")
        .groupBy("module_category", "description")
        .agg(F.max_by(pair, "hook_ord").alias("pair"))
        .groupBy("module_category")
        .agg(F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("description", "pair")))
        ).alias("pairs"))
    )


def hook_options(hooks: DataFrame, module: str, notif_code: str) -> DataFrame:
    """Option schema of one hook; no row when there is no such hook."""
    return hooks.where(
        (F.col("module") == module) & (F.col("notif_code") == notif_code)
    ).select("options")

