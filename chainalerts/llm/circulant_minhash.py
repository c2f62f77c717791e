"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all signature coordinates: sigma places a shingle on a circle of 2^20
points, pi numbers the points; coordinate k is the least number of the shingles' places after
turning the circle by k. A shingle's numbers for all k are neighbours in pi, so a signature is
the minimum of slices. Bands of ROWS coordinates make buckets; the number of bands follows from
the threshold, so that a pair at the threshold is missed with a probability below MISS.

Documents with equal sets (128-bit fingerprint) are one class from the start; classes are linked:

1. stars: each class of a bucket is compared with the bucket's least one, on full sets; links make
   components;
2. rest: a bucket of three or more classes that still are in different components is compared
   whole, in blocks of BLOCK classes against blocks, each pair in its first common band, only
   pairs of different components. A task returns a spanning forest of the links that it found.

Links of both make the result. No pair of equal texts is formed, and no pairs are emitted; hot
buckets are split into blocks, hot stars by Spark's skew join. Full sets come from the text of
candidate classes only, compressed, which is joined to them by one shuffle.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`; a set holds 64-bit hashes of `size` words (fewer
words: all of them). Defined cases: null, empty or blank text has an empty set and is linked with
nothing; component_id is the least non-null id of the component; equal rows get equal results;
an empty table gives no rows; other input columns are ignored (kept by `deduplicated`).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import (
    LOWER, SPACE, chunks, mix, row_key, shingles, span_hashes, table, text_bytes, word_spans, written,
)
from chainalerts.llm.components import components

POINTS, ROWS, MISS, BLOCK = 1 << 20, 6, 1e-6, 256


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """So many bands that a pair at the threshold shares none with a probability below miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


@cache
def _numbers(width: int) -> np.ndarray:
    """Row p: the numbers that pi gives to the points p, p + 1, ... p + width - 1."""
    pi = np.random.default_rng(7).permutation(POINTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """The circulant MinHash of a set of shingle hashes."""
    # sigma: a bijection of the hashes, then their upper bits as place.
    place = (mix(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - 20)).astype(np.int64)
    numbers, least = _numbers(width), None
    for i in range(0, len(place), 1024):
        low = numbers[place[i:i + 1024]].min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return least


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, ends = text_bytes(texts)
    low = LOWER[data]
    starts, stops, firsts = word_spans(low, ends, ~SPACE)
    found, at = shingles(span_hashes(low, starts, stops), firsts, size)
    return [np.unique(found[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def signatures(documents: DataFrame, size: int, threshold: float, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, n_shingles, node (the set's fingerprint; null for the empty set) and
    bands (a hash for each)."""
    bands = bands_for(threshold)
    kept = [f"__k{i}" for i in range(len(keep))]
    source = documents.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[k] for k in kept], T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in chunks(batch, "__text"):
                counts, nodes, made = [], [], []
                for found in shingle_sets(part.column("__text"), size):
                    counts.append(len(found))
                    if not len(found):
                        nodes.append(None)
                        made.append(None)
                        continue
                    nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    rows = signature(found, bands * ROWS).astype(np.uint64).reshape(bands, ROWS)
                    value = number
                    for column in rows.T:
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + column)
                    made.append(value.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in kept], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(made, pa.list_(pa.int64()))], schema.names)

    return source.mapInArrow(run, schema).withColumnsRenamed(dict(zip(kept, keep)))


def _compressed(documents: DataFrame, text_col: str) -> DataFrame:
    """(node key columns, z): lower-cased text of each row, compressed, by a hash of the text."""
    source = documents.select(F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("t2"),
                              F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                data, ends = text_bytes(part.column("__text"))
                z = [zlib.compress(data[a:b].tobytes(), 1) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], ["t1", "t2", "z"])

    return source.mapInArrow(run, "t1 long, t2 long, z binary")


def _sets(packed, size: int) -> list[np.ndarray]:
    return shingle_sets(pa.array([zlib.decompress(z) for z in packed], pa.binary()), size)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star_links(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                left = _sets(part.column("z").to_pylist(), size)
                right = _sets(part.column("zb").to_pylist(), size)
                good = pa.array([_alike(x, y, percent) for x, y in zip(left, right)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    return run


def _block_links(size: int, percent: int):
    """Of a block pair: a spanning forest of the links between different components."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        # The largest component of the block last: no two of its classes are compared.
        size_ = rows.groupby(rows["label"].map(bytes.hex))["node"].transform("count")
        rows = rows.assign(size=size_, name=rows["label"].map(bytes.hex)).sort_values(["size", "name"]).reset_index(drop=True)
        sets = _sets(rows["z"], size)
        bands = np.stack(rows["bands"].to_numpy())
        n, sizes = len(rows), np.array([len(x) for x in sets])
        label = np.unique(rows["name"].to_numpy(), return_inverse=True)[1]
        side = rows["side"].to_numpy()
        band, whole = int(rows["band"].iloc[0]), rows["i"].iloc[0] == rows["j"].iloc[0]
        # Shingles that two or more classes hold, as columns.
        words, counts = np.unique(np.concatenate(sets), return_counts=True)
        words = words[counts > 1]
        places = []
        for found in sets:
            at = np.searchsorted(words, found)
            at[at == len(words)] = 0
            places.append(at[words[at] == found] if len(words) else at[:0])
        edges = []
        mark = np.zeros(len(words), bool)
        flat, first = np.concatenate(places), np.concatenate([[0], np.cumsum([len(p) for p in places])])
        for x in range(int((label != label[-1]).sum())):
            others = np.arange(x + 1, n)
            others = others[(label[others] != label[x]) & (whole | (side[others] != side[x]))]
            others = others[(100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x]))]
            # Only in the pair's first common band: earlier buckets have compared it else.
            others = others[~(bands[others, :band] == bands[x, :band]).any(axis=1)]
            if not len(others):
                continue
            mark[places[x]] = True
            total = np.concatenate([[0], np.cumsum(mark[flat])])
            both = total[first[others + 1]] - total[first[others]]
            mark[places[x]] = False
            for y in others[100 * both >= percent * (sizes[x] + sizes[others] - both)].tolist():
                if label[x] != label[y]:
                    edges.append((rows["node"][x], rows["node"][y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(edges, columns=["a", "b"])

    return run


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row's key (r1, r2: id and text) and its text's (t1, t2)."""
    one, text = F.lit(1), F.col(text_col)
    r1, r2 = row_key(id_col, text_col)
    return documents.select(
        F.col(id_col).alias("__id"), r1.alias("__r1"), r2.alias("__r2"),
        F.xxhash64(text).alias("__t1"), F.xxhash64(one, text).alias("__t2"), text.alias("__body"))


def linked(documents: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __r1, __r2 (the row's key), n_shingles and label (the least node of the row's
    component; null for an empty set) of every document, as a table."""
    threshold, keys = percent / 100, ["__id", "__r1", "__r2"]
    keyed = _keyed(documents, id_col, text_col)
    every = written(signatures(keyed, size, threshold, [*keys, "__t1", "__t2"], "__body"), "signatures")
    # One row per class, with one of its texts' hashes. Candidates go by a short name, the first
    # 64 bits of the node: should two nodes share it, both are compared.
    short = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")
    classes = every.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"))).alias("t"), F.first("bands").alias("bands")).withColumn("name", short)
    buckets = classes.select("name", F.posexplode("bands").alias("band", "hash"))
    # Each side of a join with hot keys is written: then Spark can split the hot ones.
    stars = buckets.groupBy("hash").agg(F.min("name").alias("least"), F.count("*").alias("n"))
    stars = written(stars.filter("n > 1"), "stars")
    members = written(buckets.join(stars, "hash"), "buckets")
    # Candidate classes and their texts.
    chosen = classes.join(members.select("name").distinct(), "name", "left_semi").select("node", "bands", "t.t1", "t.t2")
    texts = _compressed(documents.filter(F.col(text_col).isNotNull()), text_col)
    chosen = chosen.join(texts, ["t1", "t2"]).groupBy("node").agg(F.first("bands").alias("bands"), F.first("z").alias("z"))
    chosen = written(chosen.withColumn("name", short), "candidates")
    pairs = members.filter(F.col("name") != F.col("least")).select("name", "least").distinct()
    pairs = pairs.join(chosen.select("name", F.col("node").alias("a"), "z"), "name").join(
        chosen.select(F.col("name").alias("least"), F.col("node").alias("b"), F.col("z").alias("zb")), "least")
    pairs = pairs.select("a", "b", "z", "zb")
    links = written(pairs.mapInArrow(_star_links(size, percent), "a binary, b binary"), "links")
    labels = written(components(links), "labels")
    # Buckets of three or more classes in different components.
    named = written(chosen.select("name", "node").join(labels, "node", "left"), "named")
    labelled = members.filter("n > 2").join(named, "name").select(
        "node", "band", "hash", "n", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "labelled")
    open_ = labelled.groupBy("hash").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m")
    rest = labelled.join(written(open_.select("hash"), "open"), "hash", "left_semi")
    # Blocks of a bucket, and every pair of blocks to both of its members.
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("blocks", count).withColumn("side", F.pmod(F.xxhash64("node", "hash"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("node", "label", "band", "hash", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    rest = rest.join(chosen.drop("name"), "node")
    more = rest.groupBy("hash", "i", "j").applyInPandas(_block_links(size, percent), "a binary, b binary")
    links = links.unionAll(more)
    labels = written(components(links), "labels")
    labelled = every.join(labels, "node", "left").select(
        *keys, "n_shingles", F.coalesce("label", "node").alias("label"))
    return written(labelled, "linked")


def near_duplicates(
    documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id and kept of every document."""
    rows = linked(documents, size, percent, id_col, text_col)
    least = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("__id").alias("component_id"))
    rows = rows.join(written(least, "least"), "label", "left")
    component = F.when(F.col("label").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return rows.select(F.col("__id").alias(id_col), "n_shingles", component.alias("component_id"),
                       component.eqNullSafe(F.col("__id")).alias("kept"))


def deduplicated(
    documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each component (the least id; of equal rows one) and all with empty sets,
    with their own columns."""
    rows = linked(documents, size, percent, id_col, text_col).filter(F.col("label").isNotNull())
    key = F.struct(F.col("__id").isNull().alias("n"), "__id", "__r1", "__r2")
    stay = written(rows.groupBy("label").agg(F.min(key).alias("stay")), "stay")
    lost = rows.join(stay, "label").filter(~key.eqNullSafe(F.col("stay"))).select("__r1", "__r2").distinct()
    again = rows.groupBy("__r1", "__r2").agg(F.count("*").alias("__copies")).filter("__copies > 1")
    lost = lost.select("*", F.lit(1).cast("long").alias("__copies"), F.lit(True).alias("__lost"))
    again = again.select("*", F.lit(False).alias("__lost"))
    marks = lost.unionAll(again).groupBy("__r1", "__r2").agg(F.max("__lost").alias("__lost"))
    marks = written(marks, "marks").withColumnsRenamed({"__r1": "__m1", "__r2": "__m2"})
    keyed = documents.withColumns(dict(zip(("__r1", "__r2"), row_key(id_col, text_col))))
    # One way at any size: the texts move once, to meet their marks.
    marked = keyed.join(marks.hint("merge"), (F.col("__r1") == F.col("__m1")) & (F.col("__r2") == F.col("__m2")), "left")
    kept = marked.filter(F.col("__lost").isNull()).drop("__r1", "__r2", "__m1", "__m2", "__lost")
    # Equal rows of which one stays: they are few, and each class of them is one row's size.
    repeated = marked.filter(~F.col("__lost")).dropDuplicates(["__r1", "__r2"])
    return kept.unionAll(repeated.drop("__r1", "__r2", "__m1", "__m2", "__lost"))


def op9_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
