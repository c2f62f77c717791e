"""Filter interaction audit by failing-id relations.

Each filter has a table of the ids of the documents that fail it. What a chain of filters does to
a prefix of it depends on the set of its filters only, so every set is taken once:

- survivors of a set: all ids, left-anti joined with the table of each of its filters;
- removals of a filter after a set: the filter's own ids, left-anti joined likewise;
- redundancies of a filter after a set: its ids, left-semi joined with the tables of the set;
- label losses: the labels of the removed ids, which travel with them.

Scale: texts are read once, in the map tasks; ids and verdicts are written to the shared folder.
Ids are dealt out once; the sets are unfolded in place after that (a generator keeps the
partitioning), so each left-anti join moves the few columns of one failing table and no set is
shuffled. Ids are row numbers of the written table, so no key is hot; counts are summed in the
tasks before they move, to one row per part and set. Copies are found by a 256-bit hash of the
text, grouped with a minimum that is pre-aggregated and joined back as a table, whose hot keys
Spark can split. Nothing is broadcast: these tables grow with the documents, and compress so well
that the size of their files says little.

Defined cases: null text is empty; a null or empty part is ''; repeated rows are documents each; a
null id is no copy of a smaller one and has no labels, rows of equal text and equal id are no
copies of each other; of several labels of an id, one that says 1 is enough; labels that are null
say nothing; an empty table gives no rows. Other columns are not read. For n filters the report
has n! orders: at most MOST_FILTERS are taken.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainalerts.llm.common import fenced, table, work_folder, written

MOST_FILTERS = 6
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RELATION = "rid long, part string, good boolean, toxic boolean, filter string"


def text_filters(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """The documents with helper columns, and the failure conditions of filters A to D."""
    rows = fenced(documents, __text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = fenced(rows, __words=F.split(F.btrim("__text", F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    n_words = F.when(F.element_at("__words", 1) == "", 0).otherwise(F.size("__words"))
    length = F.length("__text")
    upper = length - F.length(F.translate("__text", UPPER, ""))
    return rows, {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct("__words")) < 50 * n_words,
        "C": 100 * upper > 2 * length,
        "D": F.col("__text").rlike(r"[#$%&*|]"),
    }


def judged(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """A written table of one row per document: rid (its number), part, good, toxic (its labels)
    and fails, the names of the filters A to E that it fails."""
    rows, fails = text_filters(
        documents.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.col(text_col).alias("text")), "text")
    rows = written(rows.select(
        F.monotonically_increasing_id().alias("rid"), "id", "part",
        F.array_compact(F.array(*[F.when(c, name) for name, c in fails.items()])).alias("fails"),
        F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("hash"),
    ), "audit-rows")
    copies = rows.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    copies = written(copies.filter("least < most").select(F.col("hash").alias("of"), "least"), "audit-copies")
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    said = written(said.filter("quality OR toxic"), "audit-labels")
    rows = rows.join(copies.hint("merge"), F.col("hash") == F.col("of"), "left")
    rows = rows.join(said.hint("merge"), F.col("id") == F.col("labelled"), "left")
    copy = F.when(F.col("id") > F.col("least"), F.array(F.lit("E"))).otherwise(F.array().cast("array<string>"))
    return written(rows.select(
        "rid", "part", F.coalesce("quality", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), F.concat("fails", copy).alias("fails"),
    ), "audit-judged")


class FailingIds:
    """One table of failing ids per filter, below a folder of the shared one."""

    def __init__(self, judged_rows: DataFrame, filters: str):
        if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
            raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter each")
        self.rows, self.filters = judged_rows, "".join(sorted(filters))
        self.path = work_folder(judged_rows.sparkSession, "failing")
        judged_rows.select("rid", "part", "good", "toxic", F.explode("fails").alias("filter")).write.partitionBy(
            "filter").option("compression", "zstd").parquet(self.path)

    def all(self) -> DataFrame:
        return self.rows.sparkSession.read.schema(_RELATION).parquet(self.path)

    def of(self, name: str) -> DataFrame:
        """(rid) of one filter; the other filters' folders are not read."""
        return self.all().filter(F.col("filter") == name).select(F.col("rid").alias("failing"))

    def survivors(self) -> DataFrame:
        """(rid, part, good, toxic, filter, prefix): the ids that survive the filters of `prefix`
        (sorted letters). Rows of filter '' are documents; rows of a filter are documents that
        fail it, and its prefixes hold the others, so they are what it removes after them."""
        everything = self.rows.select("rid", "part", "good", "toxic", F.lit("").alias("filter"))
        left = everything.unionByName(self.all()).repartition("rid").withColumn("prefix", F.lit(""))
        for name in self.filters:
            both = F.when(F.col("filter") == name, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
            left = left.select("*", F.explode(both).alias("taken"))
            left = left.join(
                self.of(name).hint("merge"), (F.col("rid") == F.col("failing")) & F.col("taken"), "left_anti")
            left = left.withColumn("prefix", F.when(F.col("taken"), F.concat("prefix", F.lit(name))).otherwise(
                F.col("prefix"))).drop("taken")
        return left

    def redundant(self) -> DataFrame:
        """(rid, part, filter, prefix): ids that fail `filter` and a filter of `prefix` as well."""
        sets = ["".join(s) for n in range(1, len(self.filters)) for s in combinations(self.filters, n)]
        own = self.all().select("rid", "part", "filter").repartition("rid")
        own = own.select("*", F.explode(F.array(*map(F.lit, sets)) if sets else F.array().cast("array<string>")).alias("prefix"))
        own = own.filter(~F.col("prefix").contains(F.col("filter")))
        other = self.all().select(F.col("rid").alias("failing"), F.col("filter").alias("earlier"))
        return own.join(
            other.hint("merge"), (F.col("rid") == F.col("failing")) & F.col("prefix").contains(F.col("earlier")),
            "left_semi")

    def cells(self) -> DataFrame:
        """(part, filter, prefix) with n, good, toxic (of survivors) and redundant."""
        zero = F.lit(0).cast("long")
        by = ["part", "filter", "prefix"]
        left = self.survivors().groupBy(*by).agg(
            F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        twice = self.redundant().groupBy(*by).agg(F.count("*").alias("redundant"))
        both = left.withColumn("redundant", zero).unionByName(
            twice.select(*by, zero.alias("n"), zero.alias("good"), zero.alias("toxic"), "redundant"))
        return both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic", "redundant")])

    def report(self) -> DataFrame:
        """The rows of the audit: per part, order of the filters and step."""
        names, k = self.filters, len(self.filters)
        value = F.struct("n", "good", "toxic", "redundant")
        # In how many of all orders a filter comes right after a set of that size.
        weight = F.element_at(
            F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.length("prefix") + 1)
        # At most (k + 2) * 2^k cells a part.
        parts = self.cells().groupBy("part").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "filter", "prefix"), value))).alias("cells"),
            *[F.sum(F.when(F.col("filter") == name, F.col("n") * weight)).alias(f"shapley_{name}") for name in names])
        orders = F.array(*[F.lit("".join(order)) for order in permutations(names)])
        rows = parts.select("*", F.explode(orders).alias("filter_order"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
        letter = F.expr("substring(filter_order, step, 1)")
        ordered = lambda text: F.array_join(F.array_sort(F.split(text, "")), "")
        rows = rows.select(
            "*", letter.alias("letter"), ordered(F.expr("left(filter_order, step - 1)")).alias("before"),
            ordered(F.expr("left(filter_order, step)")).alias("after"))
        others = F.replace(F.lit(names), F.col("letter"), F.lit(""))
        cell = lambda name, prefix: F.col("cells")[F.concat_ws(":", name, prefix)]
        whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        here = cell(F.col("letter"), F.col("before"))
        shapley = F.coalesce(*[F.when(F.col("letter") == name, F.col(f"shapley_{name}")) for name in names])
        return rows.select(
            "part", "filter_order", F.col("step").cast("int").alias("step"),
            whole(cell(F.lit(""), F.col("after"))["n"]).alias("kept"), whole(here["n"]).alias("removed"),
            whole(here["redundant"]).alias("redundant"),
            whole(cell(F.col("letter"), others)["n"]).alias("unique_fails"),
            whole(here["good"]).alias("good_lost"), whole(here["toxic"]).alias("toxic_lost"),
            whole(shapley).alias("shapley"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return FailingIds(rows, "ABCDE").report()


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS bits
  FROM w LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
  FROM f GROUP BY 1, 2),
n AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM n a, n b, n c, n d, n e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
    (SELECT coalesce(sum(bit), 0) FROM n WHERE contains(substr(filter_order, 1, step - 1), letter))::INT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, letter,
    sum(c.n) FILTER (WHERE bits & (before | bit) = 0) AS kept,
    sum(c.n) FILTER (WHERE bits & before = 0 AND bits & bit > 0) AS removed,
    sum(c.n) FILTER (WHERE bits & before > 0 AND bits & bit > 0) AS redundant,
    sum(c.n) FILTER (WHERE bits = bit) AS unique_fails,
    sum(c.g) FILTER (WHERE bits & before = 0 AND bits & bit > 0) AS good_lost,
    sum(c.x) FILTER (WHERE bits & before = 0 AND bits & bit > 0) AS toxic_lost
  FROM c, s JOIN n USING (letter) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM r"""
