"""Exact removal of repeated `length`-byte strings by prefix-free parsing.

Triggers: a rolling hash of 8 bytes has a value at every position of a document; the least of
every REACH consecutive values (the last of equal ones) is a trigger. Text that is equal in
`length` bytes has the same triggers inside, so repeated text is cut alike wherever it is.

Phrases: neighbouring string starts with the same first trigger form a run; its phrase is all
that these strings hold, from the run's first byte to `length` bytes after its last one. Phrases
overlap by far more than a trigger's width; the context, the bytes from the trigger on that all
strings of the run hold, is a part of each of them. Equal strings have equal contexts.

Parse: a row per phrase and document, of hashes and places, without text.

1. Contexts that occur once go: none of their strings is repeated.
2. The dictionary has each distinct phrase of the others, with its number. All strings of a
   phrase that occurs twice are repeated. What is left are phrases that occur once but share
   their context.
3. Those are spelled and brought into order as the parse's and the dictionary's suffix arrays do:
   one sort by what follows the trigger, with the common length of neighbours, and, byte by byte
   to the left of the trigger, the classes of equal phrase suffixes. A string is repeated if a
   phrase of its class agrees in the rest of the `length` bytes. A context of more than GROUP
   phrases is not put into one task: see `refine`.

Scale: shuffles carry 20 to 40 bytes a phrase (about 50 bytes of text); compressed text moves
twice, to spell phrases and to meet its spans. Nothing is gathered but a document's own places.
A document is known by 80 bits of hashes of its id and text.

Defined cases: null is empty text; a document below `length` bytes loses nothing; equal rows (id
and text) repeat each other wholly if they are long enough; overlaps within a document count; an
empty table gives no rows. Cuts may split a character, so kept text is binary. Other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import chunks, mix, row_key, table, text_bytes, written

LENGTH, REACH, GRAM, GROUP = 200, 128, 8, 256
PARSED_BYTES = 1 << 19  # a task holds about 50 bytes of numbers for each byte of text that it parses
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Prefix sums of a text, from which any substring's hash follows."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power = np.empty(n + 1, np.uint64)
        self.power[0], self.power[1:] = 1, _FACTOR
        np.cumprod(self.power, out=self.power)
        # sum[i + 1] = sum[i] * factor + spread[byte], as (sum of spread / factor^j) * factor^i.
        inverse = np.empty(n, np.uint64)
        if n:
            inverse[0], inverse[1:] = 1, pow(int(_FACTOR), -1, 1 << 64)
            np.cumprod(inverse, out=inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SPREAD[data] * inverse, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        raw = (self.sums[stops] - self.sums[starts]) * self.power[starts]
        return mix(raw + (stops - starts).astype(np.uint64) * _FACTOR)


def _grams(data: np.ndarray) -> np.ndarray:
    """A value of 32 bits for the 8 bytes from each position on."""
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    return (eight * _FACTOR ^ eight >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def runs_of(data: np.ndarray, length: int = LENGTH, reach: int = REACH):
    """Of a document's string starts: first start and number of each run, and its trigger."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    values = _grams(data[:n + reach + GRAM - 2])
    # The last of equal least values: smaller places make larger keys.
    place = np.uint64(len(values)) - np.arange(len(values), dtype=np.uint64)
    least = values << np.uint64(32) | place
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    trigger = len(values) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    return first, np.diff(np.append(first, n)), trigger[first]


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """80 bits that name a row: r1, and r2 of 16."""
    one, other = row_key(id_col, text_col)
    return one.alias("r1"), other.bitwiseAND(F.lit(0xFFFF)).alias("r2")


# A place in one number: r2 (16 bits), lead (8: the trigger, from the run's first start on),
# n (8: starts of the run) and first (32).
def _unpacked(place: Column) -> dict[str, Column]:
    return {"r2": F.shiftrightunsigned(place, 48), "lead": F.shiftrightunsigned(place, 40).bitwiseAND(F.lit(0xFF)),
            "n": F.shiftrightunsigned(place, 32).bitwiseAND(F.lit(0xFF)), "first": place.bitwiseAND(F.lit(0xFFFFFFFF))}


def _repeated_within(row: np.ndarray, context: np.ndarray, phrase: np.ndarray) -> dict[int, list[int]]:
    """Of phrases that their document has several times: first index -> the others."""
    key = mix(context * _FACTOR + mix(phrase ^ mix(row.astype(np.uint64))))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    groups: dict[int, list[int]] = {}
    for i in np.flatnonzero(count[inverse] > 1).tolist():
        groups.setdefault(int(inverse[i]), []).append(i)
    return {at[0]: at[1:] for at in groups.values()}


def _phrases(length: int, reach: int):
    """The phrases of a batch of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", PARSED_BYTES):
                data, ends = text_bytes(part.column("__text"))
                found, rows = [], []
                for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    first, n, trigger = runs_of(data[a:b], length, reach)
                    found.append((first, n, trigger, np.full(len(first), a)))
                    rows.append(np.full(len(first), row))
                first, n, trigger, begin = (np.concatenate(x) for x in zip(*found))
                rolling, lead, rows = Rolling(data), trigger - first, np.concatenate(rows)
                context = rolling.hashes(begin + trigger, begin + trigger + length - reach + 1)
                whole = rolling.hashes(begin + first, begin + first + n - 1 + length)
                phrase = mix(whole ^ mix(lead.astype(np.uint64)))
                r2 = part.column("r2").to_numpy()[rows].astype(np.uint64)
                place = (((r2 << np.uint64(8) | lead.astype(np.uint64)) << np.uint64(8) | n.astype(np.uint64))
                         << np.uint64(32) | first.astype(np.uint64))
                again = _repeated_within(rows, context, phrase)
                stays, more = np.ones(len(rows), bool), [None] * len(rows)
                for i, others in again.items():
                    stays[others] = False
                    more[i] = place[others].view(np.int64).tolist()
                stays = np.flatnonzero(stays)
                more = pa.array(more, pa.list_(pa.int64())).take(pa.array(stays)) if again else pa.nulls(
                    len(stays), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x[stays].view(np.int64)) for x in (context, phrase)],
                     part.column("r1").take(pa.array(rows[stays], pa.int64())), pa.array(place[stays].view(np.int64)), more],
                    ["context", "phrase", "r1", "place", "more"])

    return run


def parse(documents: DataFrame, length: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(context, phrase, r1, place, more) of every phrase of every document; `more` has the other
    places of a phrase that the document has several times, so periodic text is one row."""
    source = documents.filter(F.octet_length(text_col) >= length).select(
        *_key(id_col, text_col), F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(_phrases(length, reach), "context long, phrase long, r1 long, place long, more array<long>")


def _packed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, r1, r2, z): each document's bytes, compressed, null as empty."""
    source = documents.select(F.col(id_col).alias("__id"), *_key(id_col, text_col),
                              F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for part in chunks(batch, "__text"):
                data, ends = text_bytes(part.column("__text"))
                z = [pack(data[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(z, pa.binary())], ["__id", "r1", "r2", "z"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:3], T.StructField("z", T.BinaryType())]))


def _spell(length: int):
    """The bytes of a document's phrases that are in the dictionary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["context", "phrase", "r1", "place", "m", "lead", "body"]
        for batch in batches:
            for row in range(batch.num_rows):
                text, out = unpack(batch.column("z")[row].as_py()), [[] for _ in names]
                for p in batch.column("phrases")[row].as_py():
                    body = text[p["first"]:p["first"] + p["n"] - 1 + length]
                    for column, value in zip(out, (*[p[x] for x in names[:-1]], body)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in out[:-1]], pa.array(out[-1], pa.binary())], names)

    return run


def suffix_classes(context: np.ndarray, lead: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, start) of the strings of `length` bytes that two or more starts of these
    phrases have. lead: the trigger's place in a phrase."""
    total = len(bodies)
    sizes = np.fromiter(map(len, bodies), np.int64, total)
    n = sizes - length + 1
    # What follows the trigger, filled up; 0 beyond a phrase's end, where no string reaches.
    flat = np.frombuffer(b"".join(bodies) + bytes(length), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = (begin + lead)[:, None] + np.arange(-(-length // 8) * 8)
    right = np.where(np.arange(at.shape[1]) < np.minimum(sizes - lead, length)[:, None], flat[np.minimum(at, len(flat) - 1)], 0)
    right = np.ascontiguousarray(right, dtype=np.uint8)
    order = np.lexsort([*right.view(">u8").T[::-1], context])
    a, b = right[order[:-1]], right[order[1:]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[context[order[:-1]] != context[order[1:]]] = -1
    common = np.concatenate([[-1], common])
    # Leftward from the trigger: equal phrase suffixes have equal classes.
    left, alive = np.unique(context, return_inverse=True)[1], np.arange(total)
    found_phrase, found_start = [], []
    for delta in range(int(lead.max()) + 1):
        alive = alive[lead[alive] >= delta]
        if delta:
            alive = alive[np.argsort(left[alive], kind="stable")]
            key = left[alive] << 8 | flat[begin[alive] + lead[alive] - delta]
            ids, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            left[alive] = inverse
            alive = alive[count[inverse] > 1]  # alone in its class: no further match
        if not len(alive):
            break
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(common < length - delta)
        here = alive[lead[alive] - delta < n[alive]]
        key = left[here] * (total + 1) + rank[here]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        same = here[count[inverse] > 1]
        found_phrase.append(same)
        found_start.append(lead[same] - delta)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_phrase]), np.concatenate([none, *found_start])


FOUND = ["r1", "r2", "first", "n"]


def _order(length: int):
    """Suffix order of whole contexts; rows come sorted by context."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        context, lead = rows["context"].to_numpy(), rows["lead"].to_numpy()
        phrase, start = suffix_classes(context, lead, rows["body"].to_pylist(), length)
        place = rows["place"].to_numpy().view(np.uint64)[phrase]
        first = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) + start
        return pa.RecordBatch.from_arrays(
            [rows["r1"].combine_chunks().take(pa.array(phrase)), pa.array((place >> np.uint64(48)).astype(np.int64)),
             pa.array(first), pa.array(np.ones(len(first), np.int64))], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table_ = pa.Table.from_batches(held)
            context = table_["context"].to_numpy()
            cut = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
            if cut:
                yield solve(table_.slice(0, cut))
            held, rows = table_.slice(cut).to_batches(), len(context) - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


WIDTHS = (32, 8, 2, 1)


def _node_keys(length: int, width: int):
    """Of nodes, the starts of a phrase whose distance to the trigger lies in [low, low + width):
    `shared`, a hash of what all their strings hold, and `whole`, one of all that they hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "body", 1 << 20):
                data, ends = text_bytes(part.column("body"))
                lead, low = part.column("lead").to_numpy(), part.column("low").to_numpy()
                n = np.diff(ends) - length + 1
                trigger = ends[:-1] + lead
                nearest = np.maximum(low, lead - n + 1)
                furthest = np.minimum(low + width - 1, lead)
                rolling = Rolling(data)
                shared = rolling.hashes(trigger - low, trigger + length - (low + width - 1))
                whole = mix(rolling.hashes(trigger - furthest, trigger + length - nearest)
                            ^ mix((furthest * 1024 + nearest).astype(np.uint64)))
                shared = mix(shared ^ mix(low.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64)),
                     pa.array(lead - furthest), pa.array(furthest - nearest + 1)],
                    [*part.schema.names, "shared", "whole", "at", "count"])

    return run


def refine(phrases: DataFrame, length: int, reach: int) -> DataFrame:
    """Repeated strings of contexts that have too many phrases for one task: (r1, r2, first, n).

    The starts of a phrase are split by their distance to the trigger into nodes of ever fewer.
    If another phrase holds all that a node's strings hold, all of them are repeated; if none
    holds what they share, none is; else the node is split. Of nodes that hold the same and are
    settled, one goes on as their partner (`known`), as long as others share with it. A level
    counts its nodes by hash, pre-aggregated, so a context of any size is spread over all tasks,
    and a phrase has a few nodes a level."""
    kind = "context long, r1 long, place long, lead long, body binary, low long, known boolean"
    nodes, above, found = phrases.select(
        "context", "r1", "place", "lead", "body", F.lit(0).cast("long").alias("low"), F.lit(False).alias("known")), reach, []
    for width in WIDTHS:
        # Children of a node that hold starts of the phrase.
        starts = F.octet_length("body") - (length - 1)
        low = F.explode(F.sequence(F.col("low"), F.col("low") + (above - 1), F.lit(width).cast("long")))
        nodes = nodes.withColumn("low", low).filter(
            (F.col("low") <= F.col("lead")) & (F.col("low") + width > F.col("lead") - starts + 1))
        nodes = nodes.select("context", "r1", "place", "lead", "body", "low", "known")
        keyed = written(nodes.mapInArrow(
            _node_keys(length, width), f"{kind}, shared long, whole long, at long, count long"), "nodes")
        marks = []
        for key in ("shared", "whole"):
            twice = keyed.groupBy("context", key).agg(F.count("*").alias("c"), F.min("known").alias("k"))
            twice = twice.filter("c > 1 and not k")
            marks.append(written(twice.select("context", key, F.lit(True).alias(f"{key}_again")), f"nodes-{key}"))
        judged = keyed
        for key, mark in zip(("shared", "whole"), marks):
            judged = judged.join(mark, ["context", key], "left")
        judged = written(judged.filter("shared_again").select(
            "context", "r1", "place", "lead", "body", "low", "known", "whole", "at", "count", "whole_again"), "judged")
        found.append(judged.filter("whole_again and not known").withColumns(_unpacked(F.col("place"))).select(
            "r1", "r2", (F.col("first") + F.col("at")).alias("first"), F.col("count").alias("n")))
        settled = judged.filter("whole_again or known").dropDuplicates(["context", "low", "whole"])
        nodes = judged.filter("whole_again is null and not known").unionAll(settled.withColumn("known", F.lit(True)))
        above = width
    return reduce(DataFrame.unionAll, found)


def repeated_starts(
    documents: DataFrame, length: int = LENGTH, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(r1, r2, first, n): runs of starts of repeated strings, by document key."""
    if not GRAM <= reach <= min(255, length - GRAM + 1):
        raise ValueError("reach is at most 255, and a string holds that many rolling values")
    parsed = parse(documents, length, reach, id_col, text_col)
    # Each side of a join with hot keys is written or has an exchange of its own: then Spark can
    # split the hot ones.
    times = 1 + F.coalesce(F.array_size("more"), F.lit(0)).cast("long")
    twice = written(parsed.groupBy("context").agg(F.sum(times).alias("c")).filter("c > 1").select("context"), "twice")
    shared = written(parsed.join(twice, "context", "left_semi"), "parse")
    words = shared.groupBy("context", "phrase").agg(
        F.sum(times).alias("total"), F.min(F.struct("r1", "place")).alias("p"))
    words = written(words.select("context", "phrase", "total", "p.*"), "dictionary")
    often = words.filter("total > 1").select("context", "phrase")
    whole = shared.join(often, ["context", "phrase"], "left_semi")
    places = F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<long>")))
    whole = whole.select("r1", F.explode(places).alias("place")).withColumns(_unpacked(F.col("place"))).select(*FOUND)
    # Contexts of several phrases of which one occurs once.
    sizes = words.groupBy("context").agg(F.count("*").alias("m"), F.min("total").alias("least"))
    sizes = written(sizes.filter("m > 1 and least = 1"), "sizes")
    some = words.join(sizes.select("context", "m"), "context").withColumns(_unpacked(F.col("place")))
    lists = some.groupBy("r1", "r2").agg(F.collect_list(
        F.struct("context", "phrase", "r1", "place", "m", "lead", "first", "n")).alias("phrases"))
    texts = _packed(documents, id_col, text_col).drop("__id").withColumnsRenamed({"r1": "d1", "r2": "d2"})
    spelled = lists.join(texts, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2"))).select("phrases", "z")
    kind = "context long, phrase long, r1 long, place long, m long, lead long, body binary"
    spelled = written(spelled.mapInArrow(_spell(length), kind).drop_duplicates(["context", "phrase"]), "spelled")
    found = spelled.filter(F.col("m") <= GROUP).repartition("context").sortWithinPartitions("context").mapInArrow(
        _order(length), "r1 long, r2 long, first long, n long")
    hot = refine(spelled.filter(F.col("m") > GROUP), length, reach)
    return whole.unionAll(found).unionAll(hot)


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        n_bytes, n_removed, spans, kept = [], [], [], []
        for z, starts in zip(batch.column("z"), batch.column("starts")):
            text, starts = unpack(z.as_py()), starts.values
            out: list[dict] = []
            if starts is not None and len(starts):
                first, n = starts.field("first").to_numpy(), starts.field("n").to_numpy()
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + n - 1 + length, -1)
                hit = (np.cumsum(change) > 0).astype(np.int8)
                edge = np.diff(np.concatenate([[0], hit]))
                out = [{"start": a, "end": b} for a, b in zip(
                    np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
            keep, at = [], 0
            for span in out:
                keep.append(text[at:span["start"]])
                at = span["end"]
            keep.append(text[at:])
            kept.append(b"".join(keep))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept[-1]))
            spans.append(out)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span),
             pa.array(kept, pa.binary())], ["__id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_removed, spans (start, end in bytes) and kept (binary) of every document."""
    starts = repeated_starts(documents, length, reach, id_col, text_col).groupBy("r1", "r2").agg(
        F.collect_list(F.struct("first", "n")).alias("starts"))
    texts = _packed(documents, id_col, text_col)
    rows = texts.join(starts.withColumnsRenamed({"r1": "d1", "r2": "d2"}),
                      (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2")), "left").select("__id", "z", "starts")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["__id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(lambda b: _removed(b, length), schema).withColumnRenamed("__id", id_col)


def op7_prefix_free(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
