"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into embedding tables, of whole words and of word beginnings of some
lengths, so variants of a word share weights. An embedding starts from how much more
common its bucket is in toxic training texts. Filters of several widths slide over
the sequence, each filter's largest response over the whole text is kept, and a
logistic layer reads those. Response thresholds are calibrated by language, which is
guessed from the text; a score of 0.7 is the threshold of the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.session import ship_package

from . import hashing
from .common import Scratch
from .sampling import bounded_by_class

BUCKETS = 1 << 16
#: Bytes of the word beginnings that have tables of their own.
PREFIXES = (4, 7)
TABLES = 1 + len(PREFIXES)
WIDTH = 8
FILTER_WIDTHS = (1, 2, 3)
FILTERS = 12
DECISION = 0.7
#: Rows that the common threshold counts like, beside those of a language.
SHRINK = 15
#: Training texts a bucket must occur in to have an embedding.
LEAST_TEXTS = 3
_LANG_BUCKETS = 1 << 13
#: Words of one text that are embedded at once.
SLICE_WORDS = 100_000


@dataclass
class Network:
    """Weights: embeddings, a kernel and bias for each filter width, the output layer."""

    tables: list[np.ndarray]
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def initial(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        # the last row of an embedding is the padding and stays zero
        tables = [rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32) for _ in range(TABLES)]
        for t in tables:
            t[-1] = 0
        kernels = [rng.normal(0, 0.4 / np.sqrt(k), (k * WIDTH, FILTERS)).astype(np.float32) for k in FILTER_WIDTHS]
        n = FILTERS * len(FILTER_WIDTHS)
        return cls(tables, kernels, [np.zeros(FILTERS, np.float32) for _ in FILTER_WIDTHS], rng.normal(0, 0.1, n).astype(np.float32), 0.0)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        out = self.tables[0][ids[0]]
        for t, row in zip(self.tables[1:], ids[1:]):
            out = out + t[row]
        return out

    def windows(self, x: np.ndarray, k: int) -> np.ndarray:
        return x if k == 1 else np.concatenate([x[j : len(x) - k + 1 + j] for j in range(k)], axis=1)

    def responses(self, ids: np.ndarray, begin: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Largest responses of each text; texts begin at ``begin`` in the padded ids."""
        x = self.embed(ids)
        full = number > 0
        edges = np.stack([begin[full], begin[full] + number[full]], 1).ravel()
        parts = []
        for k, w, b in zip(FILTER_WIDTHS, self.kernels, self.biases):
            top = np.zeros((len(number), FILTERS), np.float32)
            if full.any():
                act = self.windows(x, k) @ w
                top[full] = np.maximum.reduceat(act, edges, axis=0)[::2] + b
            parts.append(np.maximum(top, 0))
        return np.concatenate(parts, axis=1)

    def logits(self, ids: np.ndarray, begin: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.responses(ids, begin, number) @ self.out + self.out_bias


def bucket_ids(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each hash, in the fewest bytes."""
    return ((hashes >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.uint16)


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with padding after every text, and where texts begin."""
    pad = max(FILTER_WIDTHS)
    begin = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.full((TABLES, begin[-1]), BUCKETS, np.int32)
    out[:, np.arange(ids.shape[1]) + pad * np.repeat(np.arange(len(counts)), counts)] = ids
    return out, begin[:-1]


def bucket_evidence(texts: list[np.ndarray], labels: np.ndarray, least: int = LEAST_TEXTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table, whether a bucket occurs in so many texts, and its log odds of toxic texts in deviations."""
    out = []
    number = [(labels == c).sum() for c in (0, 1)]
    for t in range(TABLES):
        seen = np.zeros((2, BUCKETS + 1))
        for ids, y in zip(texts, labels):
            seen[y, np.unique(ids[t])] += 1
        seen[:, BUCKETS] = 0
        odds = np.log((seen[1] + 0.5) / (number[1] + 1)) - np.log((seen[0] + 0.5) / (number[0] + 1))
        out.append((seen.sum(axis=0) >= least, odds / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))))
    return out


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 5, steps: int = 1200, batch: int = 32, rate: float = 0.02) -> Network:
    """Fits a network to texts' buckets by Adam, classes balanced.

    Only buckets common among the texts have an embedding; all others stay zero, so
    neither a training text's own rare words nor words never seen can be a response.
    """
    net, rng = Network.initial(seed), np.random.default_rng(seed)
    evidence = bucket_evidence(texts, labels)
    shown = [np.where(k, np.arange(BUCKETS + 1), BUCKETS).astype(np.int32) for k, _ in evidence]
    tail = np.full((TABLES, max(FILTER_WIDTHS)), BUCKETS, np.int32)
    for (k, odds), table in zip(evidence, net.tables):
        table[:, 0] = odds / 4
        table[~k] = 0
    # the first filter of each width starts by reading the evidence
    for width, kernel in zip(FILTER_WIDTHS, net.kernels):
        kernel[:, 0] = 0
        kernel[::WIDTH, 0] = 1 / width
    net.out[::FILTERS] = 1.0
    dense = [*net.kernels, *net.biases, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    square = [np.full(BUCKETS + 1, 1e-4, np.float32) for _ in range(TABLES)]
    groups = [np.flatnonzero(labels == c) for c in (0, 1)]
    n = FILTERS
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        grads = [np.zeros_like(p) for p in dense]
        g_bias = 0.0
        rows: list[np.ndarray] = []
        row_grads: list[np.ndarray] = []
        for i in chosen:
            m = texts[i].shape[1]
            ids = np.concatenate([np.stack([s[row] for s, row in zip(shown, texts[i])]), tail], axis=1)
            x = net.embed(ids)
            top, best = [], []
            for k, w, b in zip(FILTER_WIDTHS, net.kernels, net.biases):
                act = net.windows(x, k)[: max(m, 1)] @ w
                p = act.argmax(axis=0)
                best.append(p)
                top.append(act[p, np.arange(n)] + b)
            r = np.concatenate(top)
            live = r > 0
            z = float(np.maximum(r, 0) @ net.out) + net.out_bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) / len(chosen)
            grads[-1] += d * np.maximum(r, 0)
            g_bias += d
            back = d * net.out * live
            for j, (k, w, p) in enumerate(zip(FILTER_WIDTHS, net.kernels, best)):
                g = back[j * n : (j + 1) * n].astype(np.float32)
                at = p[:, None] + np.arange(k)
                grads[j] += x[at].reshape(n, -1).T * g
                grads[len(FILTER_WIDTHS) + j] += g
                rows.append(ids[:, at.ravel()])
                row_grads.append((w.T * g[:, None]).reshape(n * k, WIDTH))
        for p, g, (m1, m2) in zip(dense, grads, moments):
            g = g + 1e-5 * p
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= rate * 0.5 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        net.out_bias -= rate * g_bias
        at, g = np.concatenate(rows, axis=1), np.concatenate(row_grads)
        for t, (table, sq) in enumerate(zip(net.tables, square)):
            where, back_to = np.unique(at[t], return_inverse=True)
            total = np.zeros((len(where), WIDTH), np.float32)
            np.add.at(total, back_to.reshape(-1), g)
            sq[where] += (total**2).mean(axis=1)
            table[where] -= rate * total / np.sqrt(sq[where])[:, None]
            table[-1] = 0
    return net


@dataclass
class Model:
    """A network, the language guesser, and each language's threshold and slope."""

    net: Network
    languages: np.ndarray
    thresholds: np.ndarray
    slopes: np.ndarray

    def language(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Most likely language of each text, by its words' buckets."""
        if len(counts) == 1:
            seen = np.bincount(ids[0] % _LANG_BUCKETS, minlength=_LANG_BUCKETS)
            return (seen @ self.languages).argmax(keepdims=True)
        edge = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([np.zeros((1, len(self.thresholds))), np.cumsum(self.languages[ids[0] % _LANG_BUCKETS], axis=0)])
        return (total[edge[1:]] - total[edge[:-1]]).argmax(axis=1)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Responses of a long text are the largest of its slices', which share the words that a filter spans."""
        n, span = int(counts[0]) if len(counts) else 0, max(FILTER_WIDTHS) - 1
        if len(counts) != 1 or n <= SLICE_WORDS:
            return self.net.logits(*padded(ids, counts), counts)
        top = np.zeros((1, FILTERS * len(FILTER_WIDTHS)), np.float32)
        for a in range(0, n, SLICE_WORDS):
            b = min(a + SLICE_WORDS, n)
            part, begin = padded(ids[:, a : b + span], np.array([min(b + span, n) - a]))
            np.maximum(top, self.net.responses(part, begin, np.array([b - a])), out=top)
        return top @ self.net.out + self.net.out_bias

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z, g = self.logits(ids, counts), self.language(ids, counts)
        shifted = (z - self.thresholds[g]) * self.slopes[g] + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(shifted, -40, 40)))


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Between two responses, the cut with the fewest errors, classes weighted to prefer clean texts 3 to 1."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)])  # toxic below the cut
    wrong = np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])  # clean above it
    cost = missed + 3 * wrong
    best = np.flatnonzero(cost == cost.min())
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    i = best[len(best) // 2]
    return float((edge[i] + edge[i + 1]) / 2)


def fit_model(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 5, steps: int = 1200) -> Model | None:
    """Network on four fifths of the sample, thresholds by language on the rest."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = np.zeros(len(labels), bool)
    for c in (0, 1):  # each class has rows to learn from
        of = np.flatnonzero(labels == c)
        held[rng.permutation(of)[: len(of) // 5]] = True
    net = train([t for t, x in zip(texts, held) if not x], labels[~held], seed, steps)
    names = sorted({x for x in langs if x is not None}) or ["any"]
    freq = np.full((_LANG_BUCKETS, len(names)), 0.1)
    for t, x in zip(texts, langs):
        if x is not None:
            np.add.at(freq[:, names.index(x)], t[0] % _LANG_BUCKETS, 1)
    model = Model(net, np.log(freq / freq.sum(axis=0)), np.zeros(len(names)), np.ones(len(names)))
    z, g = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        count = np.array([t.shape[1]])
        z[i], g[i] = model.logits(t, count)[0], model.language(t, count)[0]
    used = held if len(set(labels[held].tolist())) == 2 else np.ones(len(labels), bool)
    common = _best_threshold(z[used], labels[used])
    for k in range(len(names)):
        own = used & (g == k)
        # the fewer rows of a class a language has, the more of the common threshold it keeps
        few = int(min((labels[own] == 1).sum(), (labels[own] == 0).sum()))
        t = (few * _best_threshold(z[own], labels[own]) + SHRINK * common) / (few + SHRINK) if few else common
        spread = np.abs(z[used] - t).mean() or 1.0
        model.thresholds[k], model.slopes[k] = t, 3.0 / spread
    return model


def _words_of(n_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * len(batch)
            for at, hashes, counts in hashing.words(_lower(batch.column(1)), hashing.ALNUM, PREFIXES):
                edge = np.concatenate([[0], np.cumsum(counts)])
                for r in range(len(counts)):
                    if 0 < counts[r] <= n_most:
                        out[at + r] = bucket_ids(hashes[:, edge[r] : edge[r + 1]]).tobytes()
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), batch.column(2), batch.column(3)], names=["id", "words", "lang", "label"])

    return run


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(hashing.as_strings(column))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    most_per_class: int = 4000,
    most_words: int = 20_000,
    most_bytes: int = 96 << 20,
    steps: int = 1200,
    exclude_fold: tuple[int, int] | None = (3, 1),
) -> Model | None:
    """Fits the classifier on a bounded sample of labelled documents.

    Of each class about ``most_per_class`` labelled ids are drawn by hash, and of those
    the documents of at most ``most_words`` words; where those hold more than
    ``most_bytes`` of word buckets, a second hash draws as many as fit; that bounds what
    the driver holds. Of an id's rows that with the smallest words is taken, so a run on
    the same rows learns the same.
    ``exclude_fold`` (m, r) leaves out documents whose crc32(id as text) mod m is r.
    An id with several labels counts as toxic if one of them says so. None if the sample
    lacks a class.
    """
    spark = docs.sparkSession
    # also ships the package, which the functions below need on the workers
    scratch = Scratch(spark, "toxicity")
    marks = labels.select(labels[label_id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if exclude_fold:
        marks = marks.where(F.crc32(F.col("id").cast("string")) % exclude_fold[0] != exclude_fold[1])
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    sample = bounded_by_class(marks, "label", "id", most_per_class)
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    # the sample's size is bounded by the parameter
    drawn = rows.join(F.broadcast(sample), "id").select("id", "text", "lang", "label")
    words = drawn.mapInArrow(_words_of(most_words), "id long, words binary, lang string, label int").where("words is not null")
    # one row of an id, however many there are
    one = words.groupBy("id").agg(F.min(F.struct("words", "lang", "label")).alias("r")).select("id", "r.*")
    one = scratch.keep(one, "words")
    size = one.agg(F.sum(F.length("words"))).first()[0] or 0
    share = F.pmod(F.xxhash64("id", F.lit(19)), F.lit(1 << 30)) / float(1 << 30)
    got = sorted(one.where(share < min(1.0, most_bytes / max(size, 1))).collect(), key=lambda r: r.id)
    scratch.drop(one)
    texts = [np.frombuffer(r.words, np.uint16).reshape(TABLES, -1) for r in got]
    return fit_model(texts, np.array([r.label for r in got], np.int64), [r.lang for r in got], steps=steps)


def _score_batch(batch: pa.RecordBatch, text: int, model: Model | None) -> np.ndarray:
    out = np.zeros(len(batch))
    if model is None:
        return out
    for at, hashes, counts in hashing.words(_lower(batch.column(text)), hashing.ALNUM, PREFIXES):
        out[at : at + len(counts)] = model.scores(bucket_ids(hashes), counts)
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, null, empty and very long texts included.

    A text without words has the score of the output layer's bias alone; without a
    model every score is 0. Ids are passed through, null and repeated ones as well.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_score_batch(batch, 1, shared.value))], names=["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = DECISION) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_batch(batch, at, shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
