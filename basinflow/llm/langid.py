"""Language by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of its
documents. A text is encoded with each language's dictionary, in chunks so that a long
text can't become its own model, and the language with the smallest total wins. The
relative margin to the runner-up is the confidence: a logistic curve, fitted on sample
rows that no dictionary holds, turns it into a score, and margins too narrow to reach
the wanted accuracy are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .sampling import bounded_by_class

UNDETERMINED = "und"
CHUNK = 4096
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> Iterator[str]:
    """Runs of letters (the Unicode categories L*) in lower case."""
    for w in _WORD.findall(text.lower()):
        if w.isalpha():
            yield w
        else:  # signs that count as word characters but are numbers, such as fractions
            yield from "".join(c if c.isalpha() else " " for c in w).split()


def normalised(text: str) -> bytes:
    """Lower-case words, single-spaced: capitals, signs and a word's repeats in a row don't tell languages apart."""
    return " ".join(w for w, _ in groupby(_words(text))).encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Dictionary bytes by language, the score's curve and the least accepted margin."""

    languages: list[str]
    dictionaries: list[bytes]
    level: int
    slope: float = 50.0
    offset: float = 0.0
    least_margin: float = 0.0

    def __post_init__(self):
        self._compressors: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def sizes(self, data: bytes) -> np.ndarray:
        """Encoded bytes of the whole normalised text with each dictionary."""
        if self._compressors is None:
            import zstandard

            self._compressors = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._compressors.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False))
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            total += [len(c.compress(part)) for c in self._compressors]
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; undetermined without a letter or a learned language."""
        data = normalised(text) if text and self.languages else b""
        if not data:
            return UNDETERMINED, 0.0, 0.0
        size = self.sizes(data)
        order = np.argsort(size, kind="stable")
        margin = float(size[order[1]] / size[order[0]] - 1) if len(order) > 1 else 1.0
        score = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))
        return self.languages[order[0]], float(score), margin


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    most_docs: int = 400,
    dictionary_bytes: int = 96 << 10,
    level: int = 9,
    accuracy: float = 0.99,
    exclude_fold: tuple[int, int] | None = (5, 0),
    most_chars: int = 20_000,
) -> Model:
    """Dictionaries and curve from about ``most_docs`` documents of each language.

    Rows are drawn by a hash of the id, from those with id, text and language; texts
    beyond ``most_chars`` are not drawn, and of an id's rows that with the smallest text
    is, so a run on the same rows learns the same. ``exclude_fold`` (m, r) leaves out documents
    whose crc32(id as text) mod m is r. A fifth of the sample is kept out of the
    dictionaries to fit the curve. Without rows to learn from, the model knows no
    language and calls every text undetermined.
    """
    Scratch(docs.sparkSession, "langid")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where("id is not null and lang is not null")
    if exclude_fold:
        rows = rows.where(F.crc32(F.col("id").cast("string")) % exclude_fold[0] != exclude_fold[1])
    rows = rows.where((F.length("text") > 0) & (F.length("text") <= most_chars))
    drawn = bounded_by_class(rows, "lang", "id", most_docs).groupBy("id").agg(F.min(F.struct("text", "lang")).alias("r"))
    sample = sorted(tuple(r) for r in drawn.select("id", "r.text", "r.lang").collect())
    by_lang: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    for i, (_, text, lang) in enumerate(sample):
        if i % 5 == 4:
            held.append((text, lang))
        else:
            by_lang.setdefault(lang, []).append(text)
    names = sorted(by_lang)
    dictionaries = []
    for name in names:
        # equal shares of many documents; zstandard reaches the end of a dictionary best
        texts = [normalised(t) or b" " for t in by_lang[name]]
        share = max(200, dictionary_bytes // len(texts))
        while share < 1 << 20 and sum(min(len(t), share) for t in texts) < dictionary_bytes and share < max(map(len, texts)):
            share *= 2
        dictionaries.append(b"\n".join(t[:share] for t in texts)[-dictionary_bytes:])
    model = Model(names, dictionaries, level)
    found = [(model.predict(t), lang) for t, lang in held]
    margins = np.array([p[2] for p, _ in found])
    right = np.array([p[0] == lang for p, lang in found], float)
    if found:
        model.slope, model.offset = _logistic(margins, right)
        order = np.argsort(-margins)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= accuracy)
        model.least_margin = float(margins[order][good[-1]]) if len(good) else 1.0
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, ridge on the slope, by Newton steps."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0.5, 0.05]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.5, 0.05])
        w = w - np.linalg.solve(h, g)
    return max(float(w[0] / scale), 0.0), float(w[1])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every row.

    Whole texts are encoded. ``rejected`` marks margins too narrow to trust, where
    lang_pred is still the best guess; null texts and texts without a letter are "und",
    score 0, rejected. Null and repeated ids are passed through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, margin double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            reject = [p[0] == UNDETERMINED or p[2] < m.least_margin for p in got]
            yield pa.record_batch([batch.column(0), pa.array([p[0] for p in got], pa.string()), pa.array([p[1] for p in got], pa.float64()), pa.array([p[2] for p in got], pa.float64()), pa.array(reject, pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
