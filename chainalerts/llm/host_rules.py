"""Host-level quality rules, in DataFrame functions alone.

Base rules judge each document by its own text. Their failures are counted by host, each host's
failure rate is shrunk towards all hosts by an empirical beta prior (method of moments), and a
host whose shrunk rate reaches `reject_rate` loses its remaining documents too: the verdicts
join back to the documents.

Repeated words are those that a 3-word window covers which occurs twice or more in the text.
Window hashes (64 bits) are sorted within a document's own array, so nothing of a text is
shuffled; only a text that has equal hashes goes on to place them.

Scale: failures are summed in the map tasks first, one row per host is left. The verdicts that
reject are written as a table of the shared folder; Spark broadcasts it only if its files are
below its own limit, else it joins by shuffle and splits a hot host.

Defined cases: null or empty text has no words and fails; a null host has no verdict; hosts are
compared as they are; repeated rows count each. With no host, or hosts whose rates do not differ
more than their counts explain, the prior is as strong as `most_prior` documents. Where the mean over
all documents reaches `reject_rate` and the hosts are alike, `host_verdicts` rejects each of them,
good documents included, as op6's SQL does; `accepted` (the pipeline) takes a host only where its
rate is also more than ABOVE standard errors above the mean, so that such a corpus keeps its good
documents. Input columns
with other names are kept by `accepted` and ignored by `measures`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainalerts.llm.common import fenced, row_key, table, written

MIN_WORDS, REPEAT_PERCENT = 50, 50
ABOVE = 3.0
SPACES = " \t\n\x0b\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(values: Column) -> Column:
    """Those values of a sorted array that equal their predecessor."""
    n = F.size(values)
    same = F.zip_with(
        F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a == b, a),
    )
    return F.array_compact(same)


def measures(documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and the base measures (long) and base_failed of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Outer white space goes first, so that split gives words only; no text gives one empty word.
    step = fenced(documents.select(*keep, text.alias("__text")),
                  __words=F.split(F.btrim("__text", F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    step = fenced(step, __n=F.when(F.element_at("__words", 1) == "", 0).otherwise(F.size("__words")))
    # Windows as 64-bit hashes: of three arrays of words, each one further on.
    hashes = F.transform(F.col("__words"), lambda w: F.xxhash64(w))
    step = fenced(step, __h=F.when(F.col("__n") >= 3, hashes))
    last = F.col("__n") - 2
    window = F.zip_with(
        F.zip_with(F.slice("__h", 1, last), F.slice("__h", 2, last), lambda a, b: F.xxhash64(a, b)),
        F.slice("__h", 3, last), lambda ab, c: F.xxhash64(ab, c),
    )
    step = fenced(step, __windows=F.when(F.col("__n") >= 3, window))
    step = fenced(step, __twice=F.array_distinct(_repeats(F.sort_array("__windows"))))
    # Of the texts that have such windows: their places in order. A window covers three words,
    # fewer if the next place is nearer.
    numbered = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = fenced(step, __sorted=F.when(F.size("__twice") > 0, numbered))
    n = F.col("__n") - 2
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(none), F.slice("__sorted", 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("__sorted", 2, F.greatest(n - 1, F.lit(0))), F.array(none))
    places = F.array_compact(F.transform(
        F.arrays_zip(F.col("__sorted").alias("x"), before.alias("p"), after.alias("q")),
        lambda z: F.when((z["x"]["h"] == z["p"]["h"]) | (z["x"]["h"] == z["q"]["h"]), z["x"]["i"]),
    ))
    step = fenced(step, __places=F.when(F.col("__sorted").isNotNull(), F.sort_array(places)))
    count = F.size("__places")
    gaps = F.zip_with(
        F.slice("__places", 2, F.greatest(count - 1, F.lit(0))),
        F.slice("__places", 1, F.greatest(count - 1, F.lit(0))), lambda a, b: F.least(a - b, F.lit(3)),
    )
    covered = F.when(count > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0)
    lines = F.filter(F.split("__text", "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    step = fenced(step, __lines=lines)
    long = "long"
    return fenced(
        step.select(
            *keep, F.col("__n").cast(long).alias("n_words"),
            F.length(F.translate("__text", SPACES, "")).cast(long).alias("word_chars"),
            (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast(long).alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast(long).alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast(long).alias("n_repeat_words"),
        ),
        base_failed=(F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )


def host_verdicts(
    measured: DataFrame, host_col: str, reject_rate: float = 0.9, most_prior: float = 1000.0,
    above: float | None = None,
) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate and host_rejected. With `above`, a host is
    rejected only if its own rate is also more than so many standard errors above the mean.

    The beta prior has the mean of all documents; its strength a + b follows from how much more
    the hosts' rates vary than binomial counts would (at least 1, at most most_prior)."""
    hosts = measured.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"),
    )
    mean = F.col("k") / F.col("n")
    spread = mean * (1 - mean)
    # Between-host variance: weighted squares less the binomial share (ANOVA estimator).
    between = ((F.col("squares") - F.col("n") * mean * mean) - (F.col("hosts") - 1) * spread) / (
        F.col("n") - F.col("n2") / F.col("n"))
    strength = F.when(between > 0, F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(most_prior)))
    prior = total.select(mean.alias("mean"), F.coalesce(strength, F.lit(most_prior)).alias("strength"))
    # One row: a scalar subquery in other words, not a join of rows with rows.
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    rejected = shrunk >= reject_rate
    if above is not None:
        error = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n_docs"))
        rejected &= F.col("n_failed") / F.col("n_docs") - F.col("mean") > above * error
    return hosts.join(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), rejected.alias("host_rejected"))


def judged(measured: DataFrame, host_col: str, **options) -> DataFrame:
    """Join the hosts' verdicts back; adds kept. The measures are taken once and written."""
    measured = written(measured, "measures")
    rejected = host_verdicts(measured, host_col, **options).filter("host_rejected")
    rejected = written(rejected.select(F.col("host").alias("__host"), F.lit(True).alias("__rejected")), "hosts")
    return measured.join(rejected, F.col(host_col) == F.col("__host"), "left").withColumn(
        "kept", ~F.col("base_failed") & F.col("__rejected").isNull()).drop("__host", "__rejected")


def op6_host_quality(spark, sf_dir: str) -> DataFrame:
    measured = measures(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return judged(measured, "source").drop("source")


def accepted(
    documents: DataFrame, text_col: str = "text", host_col: str = "source", above: float | None = ABOVE, **options
) -> DataFrame:
    """The documents that the rules keep, with their own columns. The measures are taken once, of
    rows named by 128 bits of hashes of all their columns; the texts move once, to meet those
    that are rejected."""
    names = documents.columns
    key = dict(zip(("__r1", "__r2"), row_key(*names, of=documents)))
    narrow = documents.select(*[c.alias(k) for k, c in key.items()], F.col(text_col).alias("__body"), F.col(host_col).alias("__of"))
    narrow = measures(narrow, [*key, "__of"], "__body").select(*key, "__of", "base_failed")
    lost = judged(narrow, "__of", above=above, **options).filter(~F.col("kept")).select(*key).distinct()
    # One way at any size, so the plan grows evenly.
    return documents.withColumns(key).join(lost.hint("merge"), [*key], "left_anti").select(*names)


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM
    (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY 1),
m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS nd, sum(base_failed::INT)::DOUBLE AS nf FROM f WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT sum(nd) AS n, sum(nf) / sum(nd) AS mean, count(*) AS hosts, sum(nf * nf / nd) AS sq, sum(nd * nd) AS n2 FROM h),
b AS (
  SELECT mean, mean * (1 - mean) AS spread,
    ((sq - n * mean * mean) - (hosts - 1) * mean * (1 - mean)) / nullif(n - n2 / n, 0) AS btw FROM a),
p AS (SELECT mean, CASE WHEN btw > 0 THEN least(greatest(spread / btw - 1, 1.0), 1000.0) ELSE 1000.0 END AS st FROM b),
r AS (SELECT source FROM h, p WHERE (nf + mean * st) / (nd + st) >= 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM r)) AS kept
FROM f"""
