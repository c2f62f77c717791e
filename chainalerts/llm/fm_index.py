"""Benchmark decontamination by an FM-index per shard of training documents.

A shard (at most CHUNK_BYTES of text, or one document) is a sequence of words: a number for each
word that a test phrase holds, 0 for any other word or the end of a document (runs of 0 are one).
Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix whose levels answer
rank in constant time. All phrases are searched backward at once, a word a step; occurrences are
located by walking LF to the nearest sampled suffix position; hit words merge into spans.

Phrases are the `window` consecutive words of each item; a shorter item is one phrase. They are a
stated query set: the driver holds a block of them (BLOCK_BYTES of text, by hash of item and text) and sends
it with the tasks. More blocks mean more passes over the documents, whose hits are then merged
per document; documents are never collected, shuffled with their text or compared in pairs.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. They are compared by 64-bit hash.
Defined cases: null or empty text has no words and is clean; an item without words is no phrase;
equal phrases count for each of their items; an item without an id but with a text is left out by
`contamination` unless `unnamed`, as the query and the pipeline ask: then its windows are hits that
add no item; repeated documents are judged alike; an empty
benchmark leaves every document clean. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import LOWER, chunks, row_key, span_hashes, table, text_bytes, word_spans, written

WINDOW, SAMPLE, BLOCK_BYTES = 13, 16, 16 << 20
HIT = ("first", "last", "start", "end")
ARROW_HITS = pa.list_(pa.struct([(name, pa.int64()) for name in HIT]))
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(data: np.ndarray, ends: np.ndarray):
    """(hash, start, end) of every word and the number of words before each row."""
    low = LOWER[data]
    starts, stops, firsts = word_spans(low, ends, WORD)
    return span_hashes(low, starts, stops), starts, stops, firsts


class Phrases:
    """Distinct phrases of a block of items, as rows of word numbers, right-aligned."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        column = pa.array([text for _, text in items], pa.string())
        hashes, _, _, firsts = words_of(*text_bytes(column)) if items else (np.zeros(0, np.uint64),) * 4
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers.astype(np.int64) + 1
        rows, owners = [], []
        for item, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            for i in range(a, max(b - window, a if b > a else a - 1) + 1):
                row = numbers[i:min(i + window, b)]
                rows.append(np.concatenate([np.zeros(window - len(row), np.int64), row]))
                owners.append(item)
        table_ = np.array(rows, np.int64).reshape(-1, window)
        self.rows, which = np.unique(table_, axis=0, return_inverse=True) if len(rows) else (table_, np.zeros(0, int))
        self.lengths = (self.rows > 0).sum(1)
        pairs = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], 1), axis=0) if len(rows) else np.zeros((0, 2), int)
        self.first_owner = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.owners = pairs[:, 1]
        self.names = [name for name, _ in items]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that no phrase holds."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[good]] = at[good] + 1
        return out


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes: as many symbols as fit a number at first, then prefix doubling of
    those that are still tied."""
    n, bits = len(text), max(1, int(symbols).bit_length())
    depth = max(1, 63 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([text, np.zeros(depth, np.int64)])
    for i in range(depth):
        key = key << bits | padded[i:i + n]
    # A suffix that ends early is told apart by its length in the next rounds.
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    at, ranked = np.arange(n), key[order]
    while True:
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = group
        tied = ~(new & np.concatenate([new[1:], [True]]))
        at, group = at[tied], group[tied]
        if not len(at):
            return order
        places = order[at]
        follow = places + depth
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1) + 1
        ranked = group * (n + 1) + after
        sort = np.argsort(ranked)
        order[at], ranked = places[sort], ranked[sort]
        depth *= 2


class FMIndex:
    """Backward search over a sequence of numbers 0..symbols. Inside they are one higher, and a
    single 0 ends the sequence, so that the order of suffixes is that of rotations."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text, symbols = np.append(text + 1, 0), symbols + 1
        self.n, self.bits = len(text), max(1, int(symbols).bit_length())
        order = suffix_array(text, symbols)
        transform = text[order - 1]  # the whole sequence follows its end
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.ones, self.zeros = [], []
        level = transform
        for bit in range(self.bits - 1, -1, -1):
            set_ = (level >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(set_, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate([level[~set_], level[set_]])
        # Where each symbol's run begins in the last level.
        start, self.run = np.arange(symbols + 1), np.zeros(symbols + 1, np.int64)
        place = np.zeros(symbols + 1, np.int64)
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            up = (start >> bit & 1).astype(bool)
            place = np.where(up, zeros + ones[place], place - ones[place])
        self.run = place
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before `end`."""
        place = end
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            up = (symbol >> bit & 1).astype(bool)
            set_ = ones[place]
            place = np.where(up, zeros + set_, place - set_)
        return place - self.run[symbol]

    def follow(self, row: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix one symbol longer."""
        place, symbol = row, np.zeros(len(row), np.int64)
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            set_ = ones[place]
            up = ones[place + 1] > set_
            symbol = symbol | up.astype(np.int64) << bit
            place = np.where(up, zeros + set_, place - set_)
        return self.before[symbol] + place - self.run[symbol]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with each right-aligned phrase."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        alive = np.arange(len(rows))
        for column in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[alive, column]
            longer = symbol > 0
            step, symbol = alive[longer], symbol[longer] + 1
            low[step] = self.before[symbol] + self.rank(symbol, low[step])
            high[step] = self.before[symbol] + self.rank(symbol, high[step])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, from the nearest sampled one before."""
        result, steps = np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows]
            result[open_[known]] = self.positions[self.sample_rank[rows[known]]] + steps
            open_, rows = open_[~known], rows[~known]
            rows, steps = self.follow(rows), steps + 1
        return result


def _hits(part: pa.RecordBatch, phrases: Phrases):
    """Of each row: words, merged runs of hit words and the items found."""
    data, ends = text_bytes(part.column("__text"))
    hashes, starts, stops, firsts = words_of(data, ends)
    n_words = np.diff(firsts)
    spans: list[list[dict]] = [[] for _ in n_words]
    items: list[list[str]] = [[] for _ in n_words]
    numbers = phrases.symbols(hashes)
    if not len(phrases.rows) or not numbers.any():
        return n_words, spans, items
    # The sequence: words with a 0 before each document; of a run of 0 the first stays.
    text = np.insert(numbers, firsts[:-1], 0)
    word = np.insert(np.arange(len(numbers)), firsts[:-1], -1)
    keep = np.concatenate([[True], (text[1:] > 0) | (text[:-1] > 0)])
    text, word = text[keep], word[keep]
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.rows)
    found = np.repeat(np.arange(len(low)), high - low)
    if not len(found):
        return n_words, spans, items
    rows = np.arange(len(found)) + np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low)
    first = word[index.locate(rows)]
    document = np.searchsorted(firsts, first, "right") - 1
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[found], -1)
    hit = np.cumsum(change[:-1]) > 0
    for row, phrase in np.unique(np.stack([document, found], 1), axis=0).tolist():
        items[row] += [phrases.names[o] for o in phrases.owners[phrases.first_owner[phrase]:phrases.first_owner[phrase + 1]]
                       if phrases.names[o] is not None]
    for row in np.unique(document).tolist():
        items[row] = sorted(set(items[row]))
        mine = hit[firsts[row]:firsts[row + 1]].astype(np.int8)
        edge = np.diff(np.concatenate([[0], mine, [0]]))
        raw = data[ends[row]:ends[row + 1]]
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
        opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = points[starts[firsts[row] + opens] - ends[row]]
        end = points[stops[firsts[row] + closes - 1] - ends[row]]
        spans[row] = [dict(zip(HIT, x)) for x in np.stack([opens, closes, begin, end], 1).tolist()]
    return n_words, spans, items


def _merged(hits: list[dict]) -> list[dict]:
    """Overlapping or adjoining runs of hit words as one."""
    out: list[dict] = []
    for h in sorted(hits, key=lambda h: (h["first"], h["last"])):
        if out and h["first"] <= out[-1]["last"]:
            if h["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": h["last"], "end": h["end"]}
        else:
            out.append(h)
    return out


def block_of(blocks: int) -> Column:
    """The block of a benchmark row: by item and text, so that an id that repeats is spread."""
    return F.pmod(F.xxhash64("item", "text"), F.lit(blocks))


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
    unnamed: bool = False,
) -> DataFrame:
    """The columns `keep` and n_words, n_hit (long), `spans` to remove (first and last + 1 word,
    start and end in code points) and `items` found (sorted) of every document. With `unnamed`,
    texts without an item id count as hits too."""
    spark, kept = documents.sparkSession, [f"__k{i}" for i in range(len(keep))]
    text = F.col(text_col).cast("string")
    source = documents.select(
        *[F.col(c).alias(k) for c, k in zip(keep, kept)], text.alias("__text"),
        F.xxhash64(text).alias("__r1"), F.xxhash64(F.lit(1), text).alias("__r2"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    items = items.filter((F.col("item").isNotNull() | F.lit(unnamed)) & F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + size // block_bytes
    names = [*kept, "__r1", "__r2", "n_words", "spans", "items"]
    schema = T.StructType([
        *[source.schema[c] for c in [*kept, "__r1", "__r2"]], T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in HIT]))),
        T.StructField("items", T.ArrayType(T.StringType()))])

    def one_pass(block: int) -> DataFrame:
        rows = items.filter(block_of(blocks) == block).collect()
        sent = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "__text"):
                    n_words, spans, found = _hits(part, sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in [*kept, "__r1", "__r2"]], pa.array(n_words, pa.int64()),
                         pa.array(spans, ARROW_HITS), pa.array(found, pa.list_(pa.string()))], names)

        return source.mapInArrow(run, schema)

    # One plan for any number of blocks. Equal rows become one with their number, in the tasks
    # already; then a row has at most one line per block to merge, and goes out as often as it came.
    each = [one_pass(b).withColumn("__block", F.lit(b)) for b in range(blocks)]
    rows = [*kept, "__r1", "__r2"]
    every = reduce(DataFrame.unionAll, each).groupBy(*rows, "__block").agg(
        F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"),
        F.count("*").alias("__copies"))
    merged = every.groupBy(*rows).agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.first("__copies").cast("int").alias("__copies"))
    merged = merged.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(x) for x in batch.column("spans").to_pylist()]
            yield batch.set_column(names.index("spans"), "spans", pa.array(spans, ARROW_HITS))

    result = merged.mapInArrow(join, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return result.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "n_words", n_hit.alias("n_hit"), "spans", "items")


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the contamination rule leaves, as they are. Rows are judged under the
    128 bits that name them; their columns move only to lose the contaminated ones, and not at all
    where those are so few that Spark broadcasts their table."""
    names = documents.columns
    key = dict(zip(("__d1", "__d2"), row_key(*names, of=documents)))
    rows = documents.select(*[c.alias(k) for k, c in key.items()], F.col(text_col).alias("__body"))
    found = contamination(rows, benchmark, keep=tuple(key), text_col="__body", **{"unnamed": True, **options})
    dirty = found.filter(contaminated(F.col("n_words"), F.col("n_hit"))).select(*key).distinct()
    return documents.withColumns(key).join(written(dirty, "contaminated"), [*key], "left_anti").select(*names)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op5_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
