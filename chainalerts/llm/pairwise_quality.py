"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. Preference pairs are made of documents that
are labelled good and bad; the weights minimise the logistic loss on the differences of their
features, so that the model gives the chance that one document is better than another. The score
then gets a threshold: a quantile of the scores of all labelled training documents, the one that
splits their labels best.

Features: byte classes as shares of the text; lengths; shares of distinct words, word triples and
lines; words that repeat their predecessor; words that end in a symbol. Whole texts count.

Scale: texts are read once, in map tasks, and their features (some 40 numbers) are written to the
shared folder; labels are joined to these. A hot id is split by Spark, as both sides are tables.
The weights are learnt from at most PER_LABEL documents of each label and PAIRS pairs for each
(documented bounds): chosen by a hash of label and features, equal ones taken once, all tasks
together sending about twice that. The threshold is taken from all labelled training documents, by counts
over BINS score bins. Everything else covers all data, alike at every size.

Defined cases: null text is empty; empty texts have features too and get a score; repeated rows
get equal scores; a null id is not held out and has no label; null labels say nothing; of labels
that disagree both count. Without both labels there are no pairs: every score is the smoothed
share of good ones. Labels other than 0 and 1 are passed over. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainalerts.llm.common import CHUNK_BYTES, SPACE, chunks, shingles, span_hashes, table, text_bytes, word_spans, written

PER_LABEL = 3000  # documents of a label that the weights are learnt from
PAIRS = 8  # pairs of each of them
BINS = 4096
RIDGE = 1e-3
# Byte classes: name and members. All else is "other"; bytes above 127 are parts of other letters.
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32, 9, 11, 12, 13],
    "newline": [10], "stop": b".", "comma": b",", "quiet": b";:'\"()-?", "shout": b"!", "symbol": b"#$%&*",
    "bar": b"|", "markup": b"<>{}[]/\\=+_~^`@", "wide": range(128, 256),
}
_CLASS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members), _i] = 1
_WORD = ~SPACE
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|!<>{}[]/\\=+_~^`@")] = True
N_FEATURES = 2 * len(CLASSES) + 10


def _cuts(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Pieces (row, start, stop) of rows, cut outside of `inside` after about CHUNK_BYTES."""
    for row in range(len(ends) - 1):
        start, stop = int(ends[row]), int(ends[row + 1])
        while stop - start > CHUNK_BYTES:
            gaps = np.flatnonzero(~inside[data[start + CHUNK_BYTES:min(stop, start + 2 * CHUNK_BYTES)]])
            if not len(gaps):
                break
            yield row, start, start + CHUNK_BYTES + int(gaps[0])
            start += CHUNK_BYTES + int(gaps[0])
        yield row, start, stop


def _hashed(data: np.ndarray, ends: np.ndarray, inside: np.ndarray):
    """Hashes and last bytes of the spans of `inside`, and their number before each row. A row
    that is longer than a chunk is hashed piece by piece."""
    if len(data) <= 2 * CHUNK_BYTES:
        starts, stops, firsts = word_spans(data, ends, inside)
        return span_hashes(data, starts, stops), data[stops - 1] if len(stops) else np.zeros(0, np.uint8), firsts
    hashes, last, n = [], [], np.zeros(len(ends), np.int64)
    for row, start, stop in _cuts(data, ends, inside):
        part = data[start:stop]
        starts, stops, _ = word_spans(part, np.array([0, len(part)]), inside)
        hashes.append(span_hashes(part, starts, stops))
        last.append(part[stops - 1] if len(stops) else np.zeros(0, np.uint8))
        n[row + 1] += len(starts)
    return np.concatenate(hashes), np.concatenate(last), np.cumsum(n)


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The number of different hashes of every row."""
    rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return np.bincount(rows[new], minlength=len(firsts) - 1)


def _sums(flags: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[firsts[1:]] - total[firsts[:-1]]


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES) of texts as bytes. They depend on a row's own bytes only."""
    n = len(ends) - 1
    size = np.diff(ends).astype(float)
    bytes_ = np.zeros((n, 256))
    for row in range(n):
        for start in range(int(ends[row]), int(ends[row + 1]), CHUNK_BYTES):
            bytes_[row] += np.bincount(data[start:min(start + CHUNK_BYTES, int(ends[row + 1]))], minlength=256)
    shares = bytes_ @ _CLASS / np.maximum(size, 1)[:, None]
    words, last, firsts = _hashed(data, ends, _WORD)
    lines, _, line_firsts = _hashed(data, ends, _LINE)
    triples, triple_firsts = shingles(words, firsts, 3)
    n_words, n_lines, n_triples = (np.diff(x).astype(float) for x in (firsts, line_firsts, triple_firsts))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[firsts[:-1][n_words > 0]] = False
    per = lambda x, of: np.where(of > 0, x / np.maximum(of, 1), 1.0)
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(per(size, n_words)), per(_distinct(words, firsts), n_words),
        per(_distinct(triples, triple_firsts), n_triples), per(_distinct(lines, line_firsts), n_lines),
        np.where(n_words > 0, _sums(again, firsts) / np.maximum(n_words, 1), 0.0),
        np.where(n_words > 0, _sums(_SYMBOL[last], firsts) / np.maximum(n_words, 1), 0.0),
        np.log1p(per(n_words, n_lines)), (n_words == 0).astype(float),
    ]
    return np.column_stack([shares, np.sqrt(shares), *columns])


def _described(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                x = features(*text_bytes(part.column(text_col))).astype(np.float32)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], ["id", "features"])

    return run


def described(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of (id, held_out, features) of every document."""
    kind = documents.schema[id_col].dataType.simpleString()
    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = narrow.mapInArrow(_described("text"), f"id {kind}, features array<float>")
    rest = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3))
    return written(rows.select("id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "features"), "features")


@dataclass
class Ranking:
    """score = sigmoid(weights . features + offset); without weights it is a constant."""

    weights: list[float]
    offset: float
    quantile: float = 0.0

    def margin(self, x: Column) -> Column:
        if not self.weights:
            return F.lit(self.offset)
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        products = F.zip_with(x, w, lambda a, b: a.cast("double") * b)
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p) + F.lit(self.offset)

    def score(self, x: Column) -> Column:
        return _sigmoid(self.margin(x))


def _sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(margin, F.lit(-500.0)), F.lit(500.0))))


def pairs(n_good: int, n_bad: int, each: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad row of each pair: every row of either label is in at least `each` pairs (or
    with all of the other label), spread evenly."""
    most = max(n_good, n_bad)
    turn = np.repeat(np.arange(min(each, min(n_good, n_bad))), most)
    at = np.tile(np.arange(most), len(turn) // most)
    return (at + turn * (n_bad >= n_good)) % n_good, (at + turn * (n_bad < n_good)) % n_bad


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w . (good - bad))) + ridge / 2 |w|^2 over pairs,
    by Newton steps that are halved until the loss falls."""
    i, j = pairs(len(good), len(bad))
    x = good[i] - bad[j]
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -x @ w).mean() + ridge / 2 * w @ w
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))  # the chance of the other order
        gradient = -(x * p[:, None]).mean(0) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


def best_cut(counts: dict[tuple[int, int], int], bins: int = BINS) -> tuple[int, float]:
    """The bin edge that puts most rows on their label's side (of equal ones the middle), and the
    quantile that it is: the share of rows below."""
    bad, good = np.zeros(bins + 1), np.zeros(bins + 1)
    for (at, label), n in counts.items():
        (good if label else bad)[at + 1] += n
    below_bad, below_good = np.cumsum(bad), np.cumsum(good)
    right = below_bad + (below_good[-1] - below_good)
    best = np.flatnonzero(right[1:-1] == right[1:-1].max()) + 1
    edge = int(best[len(best) // 2])
    return edge, float((below_bad[edge] + below_good[edge]) / max(1.0, below_bad[-1] + below_good[-1]))


def train(rows: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = PER_LABEL) -> Ranking:
    """Learn from the rows that are not held out and have a label of 0 or 1."""
    said = labels.filter(F.col(label_col).isin(0, 1)).select(
        F.col("doc_id").alias("labelled"), F.col(label_col).cast("int").alias("label")).distinct()
    known = rows.filter(~F.col("held_out")).join(
        written(said, "labels").hint("merge"), F.col("id") == F.col("labelled")).select("label", "features")
    known = written(known, "training")
    once = known.groupBy(F.xxhash64("label", "features").alias("h")).agg(
        F.first("label").alias("label"), F.first("features").alias("features"))
    n = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    sample = []
    for label in (0, 1):
        # About twice as many by the hash's value, then exactly: the tasks send no more together.
        below = int(min(1.0, 2 * per_label / max(1, n.get(label, 0))) * (1 << 30))
        few = once.filter((F.col("label") == label) & (F.pmod("h", F.lit(1 << 30)) < below))
        least = few.orderBy("h").limit(per_label).select("features")
        sample.append(np.array([r["features"] for r in least.collect()], float))
    bad, good = sample
    if not len(bad) or not len(good):
        n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
        share = (n["k"] + 1) / (n["n"] + 2)
        return Ranking([], float(np.log(share / (1 - share))))
    both = np.concatenate([good, bad])
    mean, spread = both.mean(0), both.std(0)
    spread[spread < 1e-9] = 1.0
    w = bradley_terry((good - mean) / spread, (bad - mean) / spread) / spread
    centre = (np.median(good @ w) + np.median(bad @ w)) / 2
    ranking = Ranking(w.tolist(), -float(centre))
    at = F.least(F.floor(ranking.score(F.col("features")) * BINS), F.lit(BINS - 1)).cast("int")
    counts = known.groupBy(at.alias("at"), "label").count().collect()  # at most 2 * BINS rows
    edge, ranking.quantile = best_cut({(r["at"], r["label"]): r["count"] for r in counts})
    ranking.offset -= float(np.log(edge / (BINS - edge)))
    return ranking


def scored(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """(id, held_out, score, predicted) of described documents."""
    return rows.select("id", "held_out", ranking.score(F.col("features")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op13_pairwise_quality(spark, sf_dir: str) -> DataFrame:
    rows = described(table(spark, sf_dir, "documents"))
    return scored(rows, train(rows, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
