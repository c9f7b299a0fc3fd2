"""Document quality by co-training.

Two views of a document that share no feature: its text's content, and metadata of its
page, which are the parts of the page's URL and its markup. A classifier of boosted trees
on each view learns from the labelled sample; over several rounds, what one view is
confident of on an unlabelled pool becomes pseudo-labels for the other. Held-out labels
calibrate both views, and the calibrated views are combined to score all documents. Only
documents with a page have the second view; the others are scored by the first alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .boosting import Boosting
from .common import Scratch
from .sampling import bounded_by_class

#: Byte classes: other, space, line end, lower, upper, digit, sentence signs, !, |, other signs, beyond ASCII.
_CLASSES = 11


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for k, chars in enumerate((" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-()", "!", "|", "#$%&*+/<=>@[]\\^_`{}~"), 1):
        out[list(chars.encode())] = k
    out[128:] = 10
    return out


_CLASS = _byte_classes()


#: Values of the text view.
TEXT_VALUES = 2 + _CLASSES + 4


def text_features(column: pa.Array) -> np.ndarray:
    """Content features, a row for each text; an empty text's are zeros."""
    out = np.zeros((len(column), TEXT_VALUES))
    column = hashing.as_strings(column)
    for at, hashes, counts in hashing.words(column, hashing.ALNUM):
        n = len(counts)
        data, off = hashing.text_bytes(column.slice(at, n))
        size = np.diff(off)
        classes = np.zeros((n, _CLASSES))
        if n == 1:
            for a in range(0, len(data), 1 << 20):
                classes[0] += np.bincount(_CLASS[data[a : a + (1 << 20)]], minlength=_CLASSES)
        else:
            classes = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
        rows = out[at : at + n]
        rows[:, 0], rows[:, 1] = np.log1p(size), np.log1p(counts)
        rows[:, 2 : 2 + _CLASSES] = classes / np.maximum(size, 1)[:, None]
        value, number = hashing.shingles(hashes, counts, 3)
        word_edge, edge = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(number)])
        for r in range(n):
            if counts[r]:
                w = np.sort(hashes[word_edge[r] : word_edge[r + 1]])
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                runs = np.diff(np.append(first, len(w)))
                rows[r, -4:] = size[r] / counts[r], len(first) / len(w), runs.max() / len(w), len(hashing.distinct(value[edge[r] : edge[r + 1]])) / max(number[r], 1)
    return out


def _code(c: Column, buckets: int = 64) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(c), F.lit(buckets)), F.lit(-1)).cast("double")


#: Markup whose occurrences are counted.
_MARKS = ("<a ", "<p", "<li", "<br", "<b>", "<script", "<img", "<!--", "&", "<")


def page_features(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, page array<double>) of the pages whose URL path ends in a document's number; of several the smallest features."""
    url, html = pages[url_col].cast("string"), F.coalesce(pages[html_col].cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    size = F.length(html).cast("double")
    marks = {m: ((size - F.length(F.replace(html, F.lit(m), F.lit("")))) / len(m)) for m in _MARKS}
    values = [
        _code(host), _code(F.substring_index(host, ".", 1)), _code(F.substring_index(host, ".", -1)), F.size(F.split(path, "/")).cast("double"),
        url.startswith("https").cast("double"), url.contains("?").cast("double"), url.contains("#").cast("double"), path.endswith("/").cast("double"), path.contains(".").cast("double"),
        F.log1p(size), F.length(F.regexp_extract(html, "<title>([^<]*)", 1)).cast("double"), *marks.values(),
        marks["&"] / (size + 1), marks["<"] / (size + 1), size / (marks["<p"] + 1), marks["<a "] / (size + 1),
    ]
    found = pages.select(F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("id"), F.array(*[F.coalesce(v, F.lit(-1.0)) for v in values]).alias("page"))
    return found.where("id is not null").groupBy("id").agg(F.min("page").alias("page"))


#: Values of the page view.
PAGE_VALUES = 11 + len(_MARKS) + 4


def views(docs: DataFrame, pages: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_view array<double>, page_view array<double>) of every document; page_view is null without a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "text_view"])

    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "id long, text_view array<double>")
    if pages is None:
        return base.withColumn("page_view", F.lit(None).cast("array<double>"))
    return base.join(page_features(pages), "id", "left").select("id", "text_view", F.col("page").alias("page_view"))


@dataclass
class Model:
    """Trees of both views and the weights that combine their calibrated logits; without pages to learn from, no page trees."""

    text: Boosting
    page: Boosting | None
    calibration: np.ndarray  # slope and offset of each view
    weights: np.ndarray  # of the two calibrated logits, and an offset

    def scores(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, page and combined scores; y is NaN in rows without a page, whose page score is NaN and takes no part."""
        a = _logit(self.text.predict(x))
        own, both = self.calibrated(a, a)[0], np.full(len(x), np.nan)
        text, has = _sigmoid(own), ~np.isnan(y[:, 0])
        combined = text.copy()
        if self.page is not None and has.any():
            z = self.calibrated(a[has], _logit(self.page.predict(y[has])))
            both[has] = _sigmoid(z[1])
            combined[has] = _sigmoid(np.stack([*z, np.ones(has.sum())], 1) @ self.weights)
        return text, both, combined

    def calibrated(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (s, o), (t, p) = self.calibration
        return s * a + o, t * b + p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _ridge_logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of the columns of a, the last one the offset; the ridge holds them near ``start``, zeros if it is None."""
    centre = np.zeros(a.shape[1]) if start is None else start
    w = centre.copy()
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * (w - centre))
    return w


def _combination(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Weights of the text view's and the page view's calibrated logits, none below 0, and of the offset.

    By default the text view's answer stands: what is learnt is the change to it. A view
    that would count against its own answer gets no weight, and the rest are learnt anew.
    """
    start, used = np.array([1.0, 0.0, 0.0]), [0, 1, 2]
    while True:
        w = np.zeros(3)
        w[used] = _ridge_logistic(z[:, used], t, start=start[used])
        against = [k for k in used[:-1] if w[k] < 0]
        if not against:
            return w
        used.remove(min(against, key=lambda k: w[k]))


def co_train(x: np.ndarray, y: np.ndarray, labels: np.ndarray, pool_x: np.ndarray, pool_y: np.ndarray, rounds: int = 4, share: float = 0.05, confident: float = 0.99, seed: int = 3) -> Model | None:
    """Trains both views on labelled rows, exchanging confident pseudo-labels on the pool.

    A view is confident where its score, calibrated on held-out labels, is: a weak view
    passes few labels on. Rows without a page are NaN in y and pool_y: they train the text
    view alone, and no pseudo-label passes by them. None if a class is missing.
    """
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = np.zeros(len(labels), bool)
    for c in (0, 1):
        of = np.flatnonzero(labels == c)
        held[rng.permutation(of)[: len(of) // 4]] = True
    has, both = ~np.isnan(y[:, 0]), ~np.isnan(pool_y[:, 0])
    learn = ~held & has
    own = [[x[~held], labels[~held].astype(float)], [y[learn], labels[learn].astype(float)]]
    pools, free = [pool_x[both], pool_y[both]], [np.ones(both.sum(), bool), np.ones(both.sum(), bool)]
    paged = len(set(labels[learn].tolist())) == 2
    use = held if len(set(labels[held].tolist())) == 2 else np.ones(len(labels), bool)
    shown = [(x[use], labels[use].astype(float)), (y[use & has], labels[use & has].astype(float))]

    def curve(model: Boosting, view: int) -> np.ndarray:
        z = _logit(model.predict(shown[view][0]))
        return _ridge_logistic(np.stack([z, np.ones(len(z))], 1), shown[view][1])

    models: list[Boosting | None] = []
    for r in range(rounds):
        models = [Boosting(depth=4).fit(*own[0]), Boosting(depth=4).fit(*own[1]) if paged else None]
        if r == rounds - 1 or not both.any() or not paged:
            continue
        for a in (0, 1):
            slope, offset = curve(models[a], a)
            p, other = _sigmoid(slope * _logit(models[a].predict(pools[a])) + offset), 1 - a
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                ok = np.flatnonzero(free[other] & (sure >= confident))
                ok = ok[np.argsort(-sure[ok], kind="stable")][: max(1, int(share * len(p)))]
                free[other][ok] = False
                own[other] = [np.concatenate([own[other][0], pools[other][ok]]), np.concatenate([own[other][1], np.full(len(ok), label)])]
    a, t = _logit(models[0].predict(x[use])), labels[use].astype(float)
    model = Model(models[0], models[1], np.zeros((2, 2)), np.zeros(3))
    model.calibration[0] = curve(models[0], 0)
    if paged:
        on = has[use]
        b = _logit(models[1].predict(y[use][on]))
        model.calibration[1] = curve(models[1], 1)
        model.weights = _combination(np.stack([*model.calibrated(a[on], b), np.ones(len(b))], 1), t[on])
    return model


def fit(viewed: DataFrame, labels: DataFrame, *, label_id_col: str = "doc_id", label_col: str = "quality", most_per_class: int = 4000, most_pool: int = 8000, exclude_fold: tuple[int, int] | None = (3, 1)) -> Model | None:
    """Fits on bounded samples: of each class about ``most_per_class`` labelled ids, and about ``most_pool`` other rows with a page as pool.

    An id with several labels counts as good only if all say so. None if a class is missing.
    """
    marks = labels.select(labels[label_id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if exclude_fold:
        marks = marks.where(F.crc32(F.col("id").cast("string")) % exclude_fold[0] != exclude_fold[1])
    sample = bounded_by_class(marks.groupBy("id").agg(F.min("label").alias("label")), "label", "id", most_per_class)
    # the sample's size is bounded by the parameter; of an id's rows that with the smallest views is taken
    got = _one_of_each(viewed.join(F.broadcast(sample), "id"), "label")
    # pseudo-labels pass by documents with both views
    paged = viewed.where("id is not null and page_view is not null")
    n = paged.count()
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    pool = _one_of_each(paged.where(draw < min(1.0, most_pool / max(n, 1))).join(F.broadcast(sample.select("id")), "id", "left_anti"))

    def matrix(rows: list, k: int, width: int) -> np.ndarray:
        return np.array([r[k] or [np.nan] * width for r in rows], float).reshape(len(rows), width)

    if not got:
        return None
    return co_train(matrix(got, 1, TEXT_VALUES), matrix(got, 2, PAGE_VALUES), np.array([r[3] for r in got]), matrix(pool, 1, TEXT_VALUES), matrix(pool, 2, PAGE_VALUES))


def _one_of_each(rows: DataFrame, *columns: str) -> list:
    """(id, text_view, page_view, columns...) of each id's smallest row."""
    best = F.min(F.struct("text_view", "page_view", *columns)).alias("r")
    return sorted(rows.groupBy("id").agg(best).select("id", "r.*").collect(), key=lambda r: r[0])


def score(docs: DataFrame, pages: DataFrame | None, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, score, text_score, page_score) of every document, trained on ``labels``.

    Whole texts are read; null and empty ones have zero content features. Rows with null
    or repeated ids are scored like others, a null id matches no page. page_score is null
    without a page. Without labels of both classes every other score is 0.5. Extra columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    viewed = scratch.keep(views(docs, pages, id_col, text_col), "views")
    shared = spark.sparkContext.broadcast(fit(viewed, labels, **params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            has = np.asarray(batch.column(2).is_valid())
            if model is None:
                found = np.full(n, 0.5), np.where(has, 0.5, np.nan), np.full(n, 0.5)
            else:
                y = np.full((n, PAGE_VALUES), np.nan)
                y[has] = np.asarray(batch.column(2).flatten()).reshape(-1, PAGE_VALUES)
                found = model.scores(np.asarray(batch.column(1).flatten()).reshape(n, -1), y)
            yield pa.record_batch([batch.column(0), pa.array(found[2]), pa.array(found[0]), pa.array(found[1], from_pandas=True)], names=["doc_id", "score", "text_score", "page_score"])

    return viewed.select("id", "text_view", "page_view").mapInArrow(run, "doc_id long, score double, text_score double, page_score double")
