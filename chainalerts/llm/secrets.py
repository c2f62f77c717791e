"""Secret scan by a trigram inverted index.

Each rule is a regular expression. `trigram_query` derives from its syntax tree what trigrams
(of the text with A-Z lower-cased) every match holds, as AND and OR of byte trigrams. A shard of
documents gets an inverted index, trigram -> ascending document numbers, of the trigrams that
the rules ask for; each query intersects and unites postings, and the rule runs on the candidate
documents alone. A rule without mandatory trigrams scans every document of the shard.

A shard is at most CHUNK_BYTES of text or one document, so memory is bounded however large a
source is, nothing is shuffled, and a lost task is simply run again. Defined cases: null text is
empty; an empty text has no spans; repeated rows are scanned alike; input columns other than the
id and the text are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import LOWER, chunks, table, text_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of `group` that a match needs to count
    group: int = 0
    any_case: bool = False

    def expression(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def searched(self) -> re.Pattern:
        """What runs on a text. A class repeated to the end of a match takes the whole run, so a
        least length of the whole match may go into the pattern: it skips short runs early."""
        if not self.group and self.pattern.endswith("]+"):
            head, _, run = self.pattern[:-1].rpartition("[")
            if head.isalnum() or not head:
                return re.compile(f"{head}[{run}{{{max(1, self.least - len(head))},}}", re.ASCII)
        return self.expression()


# The rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# The method's own: published formats of private keys and service tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

# A query is True (no demand), a trigram as bytes, or ("and" | "or", parts).
Query = bool | bytes | tuple


def _joined(op: str, parts: Sequence[Query]) -> Query:
    if op == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _grams(texts: Sequence[str]) -> Query:
    """What one of the texts demands; a text below three bytes demands nothing."""
    each = []
    for text in texts:
        raw = text.encode().translate(bytes(LOWER))
        each.append(_joined("and", [raw[i:i + 3] for i in range(len(raw) - 2)]))
    return _joined("or", each)


def _texts(item, limit: int = 64) -> list[str] | None:
    """All texts that a part of a pattern matches, if they are few."""
    op, value = item
    if op is sre.LITERAL:
        return [chr(value)]
    if op is sre.IN and all(k is sre.LITERAL for k, _ in value):
        return [chr(c) for _, c in value]
    if op is sre.SUBPATTERN:
        return _product(value[3], limit)
    if op is sre.BRANCH:
        options = [_product(x, limit) for x in value[1]]
        return None if any(x is None for x in options) else sum(options, [])
    if op is sre.MAX_REPEAT and value[1] <= 2:
        once = _product(value[2], limit)
        return None if once is None else [t for n in range(value[0], value[1] + 1)
                                          for t in reduce(lambda a, b: [x + y for x in a for y in b], [once] * n, [""])]
    return None


def _product(items, limit: int) -> list[str] | None:
    found = [""]
    for item in items:
        each = _texts(item, limit)
        if each is None or len(found) * len(each) > limit:
            return None
        found = [a + b for a in found for b in each]
    return found


def _demand(items) -> Query:
    parts: list[Query] = []
    run: list[str] = [""]
    for item in items:
        each = _texts(item)
        if each is not None and len(run) * len(each) <= 64:
            run = [a + b for a in run for b in each]
            continue
        parts.append(_grams(run))
        run = [""]
        op, value = item
        if each is not None:
            run = each
        elif op is sre.SUBPATTERN:
            parts.append(_demand(value[3]))
        elif op is sre.BRANCH:
            parts.append(_joined("or", [_demand(x) for x in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            parts.append(_demand(value[2]))
    return _joined("and", [*parts, _grams(run)])


def trigram_query(pattern: str) -> Query:
    """The trigrams that each match of the pattern holds, letters lower-cased."""
    return _demand(_parser.parse(pattern))


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def postings(data: np.ndarray, ends: np.ndarray, wanted: Sequence[bytes]) -> dict[bytes, np.ndarray]:
    """The inverted index of a shard: which of its rows hold each wanted trigram."""
    none = np.zeros(0, np.int64)
    if len(data) < 3 or not wanted:
        return dict.fromkeys(wanted, none)
    marked = np.zeros(1 << 24, bool)
    marked[[_code(g) for g in wanted]] = True
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    at = np.flatnonzero(marked[code])
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + 3 <= ends[row + 1]
    at, row = at[inside], row[inside]
    pairs = np.unique(code[at].astype(np.int64) << 32 | row)
    index = {}
    for gram in wanted:
        a, b = np.searchsorted(pairs, [_code(gram) << 32, (_code(gram) + 1) << 32])
        index[gram] = pairs[a:b] & 0xFFFFFFFF
    return index


def candidates(query: Query, index: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    if query is True:
        return np.arange(rows)
    if isinstance(query, bytes):
        return index[query]
    each = sorted((candidates(q, index, rows) for q in query[1]), key=len)
    if query[0] == "or":
        return np.unique(np.concatenate(each))
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), each)


def scan(
    documents: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id and `spans`, an array of (kind, start, end) by start and then by rule order."""
    source = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([source.schema["__id"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(n, r, trigram_query(r.pattern), r.searched()) for n, r in enumerate(rules)]
        wanted = sorted(set().union(*(trigrams(q) for _, _, q, _ in asked)))
        for batch in batches:
            for part in chunks(batch, "__text"):
                data, ends = text_bytes(part.column("__text"))
                index = postings(data, ends, wanted)
                texts: dict[int, str] = {}
                spans: list[list[tuple]] = [[] for _ in range(part.num_rows)]
                for number, rule, query, expression in asked:
                    for row in candidates(query, index, part.num_rows).tolist():
                        if row not in texts:
                            texts[row] = data[ends[row]:ends[row + 1]].tobytes().decode()
                        for match in expression.finditer(texts[row]):
                            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                                spans[row].append((match.start(), number, match.end()))
                found = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(s)] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, arrow)], ["__id", "spans"])

    return source.mapInArrow(find, schema).withColumnRenamed("__id", id_col)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))

    def joined(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE_RULES],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES)) -> list[tuple[str, int, int]]:
    """Every rule over the whole text, for tests."""
    found = []
    for number, rule in enumerate(rules):
        for m in rule.expression().finditer(text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), number, rule.kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]
