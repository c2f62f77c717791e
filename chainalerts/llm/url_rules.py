"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host (it fits that host and every subdomain), a path prefix and optionally a regular
expression over `host + path`. Literal tokens are maximal runs of [a-z0-9]; a token is mandatory
if whatever the rule matches holds it as a whole token. Each rule is filed under its rarest
mandatory token, by how many of the given urls hold it; a url's tokens fetch candidate rules and
only those are tested. A rule without a mandatory token is a candidate for every url.

Rules are configuration of a bounded number (MAX_RULES), held by the driver and sent with the
tasks. Defined cases: a null url or one without `://` has an empty host and path; the first of
equally long rules in rule order wins; repeated rows are judged alike; columns of the input other
than the id and the url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """host and path of a base rule ("net", "/"), or a pattern over host + path."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()  # whole tokens that every match of the pattern holds

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def tokens(self) -> set[str]:
        found = {t.lower() for t in self.literals} | set(_TOKEN.findall(self.host))
        for token in re.finditer(r"[A-Za-z0-9]+", self.path):
            # The url goes on after the prefix: its last token may be only a part of one.
            if token.end() < len(self.path):
                found.add(token.group().lower())
        return found

    def expression(self) -> re.Pattern:
        if self.pattern:
            return re.compile(self.pattern)
        return re.compile(rf"(?:[^/]*\.)?{re.escape(self.host)}\n{re.escape(self.path)}", re.DOTALL)


# The rules of the contract.
BASE_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
# The method's own rules for urls that no base rule fits: host labels of link farms and shops
# that pages in search spam use. \n stands between host and path.
PATTERN_RULES = (
    Rule("block", pattern=r"(?:[^\n]*[.-])?spam-farm[.-]", literals=("spam", "farm")),
    Rule("block", pattern=r"(?:[^\n]*[.-])?(?:cheap|discount)-pills[.-]", literals=("pills",)),
    Rule("block", pattern=r"(?:[^\n]*[.-])?(?:online|best)-casino[.-]", literals=("casino",)),
    Rule("block", pattern=r"(?:[^\n]*[.-])?(?:free|online)-bets[.-]", literals=("bets",)),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    ascii_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, ascii_upper, ascii_upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; as many numbers as tokens."""
    wanted = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    held = F.array_intersect(F.split(F.lower(F.concat_ws("\n", "__host", "__path")), "[^a-z0-9]+"), wanted)
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by rarest mandatory token; under "" those that have none."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(number)
    return index


def judge(
    pages: DataFrame, rules: Sequence[Rule] = BASE_RULES, patterns: Sequence[Rule] = PATTERN_RULES,
    id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """id, host, path, rule (the longest base rule that fits, or null) and verdict of each row;
    `pattern` is the method's rule that decided where no base rule fits."""
    every = [*rules, *patterns]
    if len(every) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    urls = pages.select(
        F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("__host"),
        path_of(F.col(url_col)).alias("__path"),
    )
    counts = token_counts(urls, sorted(set().union(*[r.tokens() for r in every])))
    index, base = rule_index(every, counts), len(rules)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.expression() for r in every]
        always = index.get("", [])
        for batch in batches:
            names, verdicts, by = [], [], []
            for host, path in zip(batch.column("__host").to_pylist(), batch.column("__path").to_pylist()):
                url = f"{host}\n{path}"
                candidates = list(always)
                for token in set(_TOKEN.findall(url.lower())) & index.keys():
                    candidates += index[token]
                fit = [n for n in candidates if compiled[n].match(url)]
                best = min((n for n in fit if n < base), key=lambda n: (-len(every[n].name), n), default=None)
                own = min((n for n in fit if n >= base), default=None)
                names.append(None if best is None else every[best].name)
                by.append(every[own].pattern if best is None and own is not None else None)
                verdicts.append(every[best].verdict if best is not None
                                else every[own].verdict if own is not None else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.string()),
                 pa.array(verdicts, pa.string()), pa.array(by, pa.string())],
                ["__id", "__host", "__path", "rule", "verdict", "pattern"],
            )

    schema = T.StructType([
        *urls.schema.fields, T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()), T.StructField("pattern", T.StringType()),
    ])
    judged = urls.mapInArrow(decide, schema)
    return judged.select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
        "rule", "verdict", "pattern",
    )


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    from chainalerts.llm.common import table

    return judge(table(spark, sf_dir, "pages")).drop("pattern")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || chr(10), '(^|[.-])(spam-farm|cheap-pills|discount-pills|online-casino|best-casino|free-bets|online-bets)[.-]') THEN 'block'
  ELSE 'allow' END AS verdict
FROM j"""
