"""Language identification by a linear-chain conditional random field.

A word's emission is the sum of hashed feature weights: affixes (byte 1- to 3-grams with the word's
edge), inner n-grams and a lexicon entry (the whole word). Learned transitions tie neighbouring
words; forward-backward gives each word's posterior over the languages, also where a text switches
within a line. A document's language has the largest mean posterior, which is its score.

A chain is a line, cut after CHAIN words; every word of every text is labelled. Chains of a chunk
run in step, longest first, so a step is one array operation over all chains still going.

Learning: the driver takes at most `per_label` documents (those with the lowest hash of id and
text, equal ones once) of each of the MOST_LABELS most frequent labels, and CHARS characters of
each: a bounded sample whatever the table's size, ids and labels are. Pieces of documents
of different labels are strung together, so that transitions see switches. Rows whose remainder
says held out, or whose label is null, are not learned from. The model (BUCKETS x labels numbers)
is broadcast; its size does not depend on the data.

Defined cases: null text or text without a letter is `und` with score 0; without any labelled row
all texts are `und`; equal rows get equal results; a null id is never held out nor learned from;
equal scores go to the first label in order. Other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import LOWER, chunks, mix, row_key, span_hashes, table, text_bytes, word_spans, written

BUCKETS, CHAIN, CHARS, PER_LABEL = 1 << 17, 256, 3000, 300
MOST_LABELS = 64  # the most frequent; bounds sample and model whatever the labels are
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the upper-case letters of Latin-1 (two bytes, the first C3) in lower case."""
    low = LOWER[data]
    second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[second] += 0x20
    return low


class Words:
    """The words of a chunk of texts, its distinct ones and the features of those."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        low = lowered(data)
        self.starts, self.stops, self.firsts = word_spans(low, ends, _LETTER)
        hashes = span_hashes(low, self.starts, self.stops)
        self.known, example, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self._low, self._first, self._last = low, self.starts[example], self.stops[example]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers of all distinct words' features, and where each word's begin."""
        n = self._last - self._first
        width = n + 2  # with an edge on either side
        at = np.concatenate([[0], np.cumsum(width)])
        word = np.repeat(np.arange(len(n)), width)
        offset = np.arange(at[-1]) - at[word]
        inner = (offset > 0) & (offset <= n[word])
        text = np.zeros(at[-1] + 3, np.uint64)
        text[:-3][inner] = self._low[(self._first[word] + offset - 1)[inner]]
        found, owner = [mix(self.known)], [np.arange(len(n))]
        for size in (1, 2, 3):
            good = offset + size <= width[word]
            if size == 1:
                good &= inner
            value = np.full(int(good.sum()), size, np.uint64)
            place = np.flatnonzero(good)
            for i in range(size):
                value = value << np.uint64(8) | text[place + i]
            found.append(mix(value))
            owner.append(word[place])
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        bucket = (np.concatenate(found)[order] >> np.uint64(40)).astype(np.int64) % BUCKETS
        return bucket, np.searchsorted(owner[order], np.arange(len(n)))


def chains(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: the words of a line, CHAIN at most."""
    total = len(words.starts)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([words.firsts[:-1], np.searchsorted(words.starts, breaks)]))
    first = first[first < total]
    length = np.diff(np.append(first, total))
    parts = -(-length // CHAIN)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + inside * CHAIN
    return start, np.minimum(CHAIN, np.repeat(first + length, parts) - start)


class Steps:
    """Words in step order: first words of all chains, longest chain first, then second words."""

    def __init__(self, start: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        longest = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(longest), self.active)
        self.word = start[np.arange(self.offset[-1]) - self.offset[step]] + step


def forward_backward(emission: np.ndarray, transition: np.ndarray, steps: Steps, pairs: bool = False):
    """Posteriors of words in step order; with pairs, also the expected label pairs."""
    labels = emission.shape[1]
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    forward, backward = np.empty_like(local), np.ones_like(local)
    spans = list(zip(steps.offset[:-1].tolist(), steps.active.tolist()))
    for t, (at, n) in enumerate(spans):
        row = local[at:at + n]
        if t:
            before = spans[t - 1][0]
            row = row * (forward[before:before + n] @ transition)
        forward[at:at + n] = row / row.sum(axis=1, keepdims=True)
    for t in range(len(spans) - 2, -1, -1):
        (at, _), (next_, n) = spans[t], spans[t + 1]
        row = (local[next_:next_ + n] * backward[next_:next_ + n]) @ transition.T
        backward[at:at + n] = row / row.sum(axis=1, keepdims=True)
    posterior = forward * backward
    posterior /= posterior.sum(axis=1, keepdims=True)
    if not pairs:
        return posterior
    expected = np.zeros((labels, labels))
    for t in range(len(spans) - 1):
        (at, _), (next_, n) = spans[t], spans[t + 1]
        joint = forward[at:at + n, :, None] * transition * (local[next_:next_ + n] * backward[next_:next_ + n])[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return posterior, expected


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.transition = np.zeros((len(labels), len(labels)), np.float32)  # logarithms

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of the distinct words."""
        if not len(words.known):
            return np.zeros((0, len(self.labels)), np.float32)
        bucket, first = words.features()
        return np.add.reduceat(self.weights[bucket], first, axis=0)

    def posteriors(self, words: Words, data: np.ndarray) -> np.ndarray:
        steps = Steps(*chains(words, data))
        result = np.empty((len(words.which), len(self.labels)), np.float32)
        if len(result) and self.labels:
            local = self.emissions(words)[words.which[steps.word]]
            result[steps.word] = forward_backward(local, np.exp(self.transition), steps)
        return result


def fit(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 0.2, seed: int = 5) -> Model:
    """A model of (label, text) rows by AdaGrad on the log-likelihood of strung-together pieces."""
    random = np.random.default_rng(seed)
    model = Model(sorted({label for label, _ in sample}))
    number = {label: i for i, label in enumerate(model.labels)}
    data, ends = text_bytes(pa.array([text for _, text in sample], pa.string()))
    words = Words(data, ends)
    if len(words.known) == 0 or len(model.labels) < 2:
        return model
    bucket, first = words.features()
    count = np.diff(np.append(first, len(bucket)))
    pieces = []  # (first word, length, label)
    for (label, _), a, b in zip(sample, words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        while a < b:
            n = int(random.integers(4, 40))
            pieces.append((a, min(n, b - a), number[label]))
            a += n
    squares = np.full(model.weights.shape, 1e-3, np.float32)
    t_squares = np.full(model.transition.shape, 1e-3, np.float32)
    for _ in range(epochs):
        # Mostly whole documents' neighbours, sometimes a switch: pieces in order or shuffled.
        blocks = [pieces[i:i + 4] for i in range(0, len(pieces), 4)]
        random.shuffle(blocks)
        order = [p for block in blocks for p in block]
        for i in range(0, len(order), 512):
            batch = order[i:i + 512]
            word = np.concatenate([np.arange(a, a + n) for a, n, _ in batch])
            truth = np.repeat([y for _, _, y in batch], [n for _, n, _ in batch])
            length = np.full(-(-len(word) // 64), 64)
            length[-1] = len(word) - 64 * (len(length) - 1)
            steps = Steps(np.arange(len(length)) * 64, length)
            distinct, inverse = np.unique(words.which[word], return_inverse=True)
            n = count[distinct]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            features = bucket[np.repeat(first[distinct] - begin, n) + np.arange(n.sum())]
            score = np.add.reduceat(model.weights[features], begin, axis=0)
            posterior, expected = forward_backward(score[inverse[steps.word]], np.exp(model.transition), steps, True)
            error = -posterior
            error[np.arange(len(error)), truth[steps.word]] += 1
            per_word = np.zeros((len(distinct), len(model.labels)), np.float32)
            np.add.at(per_word, inverse[steps.word], error)
            used, place = np.unique(features, return_inverse=True)
            gradient = np.zeros((len(used), len(model.labels)), np.float32)
            np.add.at(gradient, place, np.repeat(per_word, n, axis=0))
            gradient -= 1e-3 * model.weights[used]
            squares[used] += gradient**2
            model.weights[used] += rate * gradient / np.sqrt(squares[used])
            inner = np.ones(len(word), bool)
            inner[np.arange(len(length)) * 64] = False
            seen = np.zeros_like(model.transition)
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            step = (seen - expected).astype(np.float32)
            t_squares += step**2
            model.transition += rate * step / np.sqrt(t_squares)
    return model


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_sample(documents: DataFrame, per_label: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str]]:
    """At most per_label texts of each of the MOST_LABELS most frequent labels: those with the
    lowest hash of id and text. Equal rows count once, so no repeated id or text fills a sample or
    pushes a label out of it. Names of rows are thinned by their hash to about twice as many as are
    asked for, and only these are ranked; the texts of the chosen ones follow."""
    rows = documents.filter((remainder(id_col) != 1) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).alias("label"), row_key(id_col, text_col)[0].alias("v"),
                       F.substring(text_col, 1, CHARS).alias("text"))
    names = written(rows.select("label", "v").distinct(), "names")
    counts = names.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(MOST_LABELS)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_label) / F.col("count"))
    few = names.join(F.broadcast(counts), "label").filter(F.pmod("v", F.lit(1 << 30)) < share * (1 << 30))
    least = Window.partitionBy("label").orderBy(F.pmod("v", F.lit(1 << 30)), "v")
    names = few.withColumn("__n", F.row_number().over(least)).filter(F.col("__n") <= per_label).select("label", "v")
    chosen = rows.join(F.broadcast(names), ["label", "v"]).groupBy("label", "v").agg(F.min("text").alias("text"))
    found = chosen.collect()  # at most MOST_LABELS * per_label
    return [(r["label"], r["text"]) for r in sorted(found, key=lambda r: (r["label"], r["v"]))]


def identify(
    documents: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
) -> DataFrame:
    """id, held_out, lang_pred and score of every document."""
    model = fit(training_sample(documents, per_label, id_col, text_col, label_col))
    sent = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col(id_col).alias("__id"), F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out"),
                              F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in chunks(batch, "__text"):
                data, ends = text_bytes(part.column("__text"))
                words = Words(data, ends)
                posterior = model.posteriors(words, data)
                total = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(posterior, axis=0, dtype=np.float64)])
                names, scores = [], []
                for row, (a, b) in enumerate(zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist())):
                    if a == b or not model.labels or not _has_letter(data[ends[row]:ends[row + 1]]):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    mean = (total[b] - total[a]) / (b - a)
                    best = int(mean.argmax())
                    names.append(model.labels[best])
                    scores.append(float(min(1.0, max(0.0, mean[best]))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def _has_letter(raw: np.ndarray) -> bool:
    low = raw | 0x20
    if ((low >= 97) & (low <= 122)).any():
        return True
    return any(c.isalpha() for c in raw.tobytes().decode())


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def op3_language_crf(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
