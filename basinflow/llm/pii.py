"""Personal data by boosted trees over candidate spans.

Four rules give the base spans, which are always kept. Where they leave room, generators
with high recall propose overlapping spans: spelled-out addresses, windows of digit groups
as cards and phone numbers, addresses with marked dots, and long runs of letters and
digits as secrets. Gradient-boosted trees score each by its format and its context. They
learn on a bounded sample's proposals: those that the sample's own spans become when they
are rewritten in other formats in their context, or stand side by side, are right; other
windows on them, spans whose form is broken and the sample's free proposals are wrong.
Values assigned to a name that says secret are right as secrets. Per kind, the least
score at which held-out proposals reach the wanted precision is the threshold; of
overlapping survivors the best scored is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosting
from .common import Scratch

#: The first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Everything that ip, card and phone spans consist of, from a digit or plus on: they never cross its ends.
_ZONE = re.compile(r"[0-9+][0-9\x20().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the four rules, by start then kind, and the matches that a rule's check rejects."""
    spans: list[Span] = []
    rejects: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            spans.append((start, free, 0))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        part = zone[0]
        if part.count(".") >= 3:
            for m in _IP.finditer(part):
                ok = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
                (spans if ok else rejects).append((a + m.start(), a + m.end(), 1))
        if b - a >= 12:
            for m in _CARD.finditer(part):
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19:
                    (spans if luhn(digits) else rejects).append((a + m.start(), a + m.end(), 2))
        if "+" in part:
            for m in _PHONE.finditer(part):
                n = len(_NOT_DIGIT.sub("", m[0]))
                (spans if 9 <= n <= 15 else rejects).append((a + m.start(), a + m.end(), 3))
    spans.sort(key=lambda s: (s[0], s[2]))
    return spans, rejects


_SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\sat\s|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]{1,63}){1,5}", re.I)
#: What stands for the @ of a spelled address, from its second character on, how a domain must go on behind it, and all characters before it.
_AT = re.compile(r"[aA][tT](?:(?<=\(..)\)|(?<=\[..)\]|(?<=\s..)(?=\s))")
_DOMAIN_STARTS = re.compile(r"\s{0,2}[A-Za-z0-9-]{1,63}\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]", re.I)
_BEFORE_AT = _LOCAL | frozenset("İıſK")  # letters that fold to i, s and k
_SENTENCE_END = re.compile(r"\.\s")
_MARKED_IP = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,2}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\sdot\s|\.)\s?[0-9]{1,3}){3}(?![0-9])", re.I)
_RUN = re.compile(r"[A-Za-z0-9_+/=~-]+")
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=~-")
_ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=(?=[^=])")
_GROUP = re.compile(r"[0-9]+")
#: Country code in front of a national number.
_COUNTRY = re.compile(r"\+[0-9]{0,3}[ .-]{0,2}\(?$")
_GAP = frozenset(["", *" .-()", *(a + b for a in " .-()" for b in " .-()")])
_LETTER = re.compile(r"[A-Za-z]")
_DIGIT = re.compile(r"[0-9]")


class Taken:
    """Disjoint intervals, kept sorted: overlap by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """Adds an interval that overlaps none."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def free(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """What is left of [a, b)."""
        i = bisect_right(self.ends, a)
        while i < len(self.starts) and self.starts[i] < b:
            if a < self.starts[i]:
                yield a, self.starts[i]
            a = self.ends[i]
            i += 1
        if a < b:
            yield a, b


def _windows(text: str, a: int, b: int) -> Iterator[Span]:
    """Cards and phone numbers as windows of the digit groups in text[a:b], at group borders."""
    groups = [m.span() for m in _GROUP.finditer(text, a, b)]
    gaps = [text[x[1] : y[0]] if y[0] - x[1] <= 2 else None for x, y in zip(groups, groups[1:])]
    joined = [g in _GAP for g in gaps]
    for i, (start, _) in enumerate(groups):
        opens = i == 0 or not joined[i - 1] or gaps[i - 1][-1:] in (" ", "(")
        digits = ""
        for j in range(i, len(groups)):
            if j > i and not joined[j - 1]:
                break
            x, end = groups[j]
            if len(digits) + end - x > 19:
                break
            digits += text[x:end]
            if 12 <= len(digits) and luhn(digits):
                yield start, end, CARD
            closes = j + 1 == len(groups) or not joined[j] or " " in gaps[j]
            if opens and closes and 7 <= len(digits) <= 15:
                bracket = start > a and text[start - 1] == "(" and ")" in text[start:end]
                # a number is proposed with its country code, or it would stay behind
                code = _COUNTRY.search(text, max(a, start - 7), start)
                yield code.start() if code else start - bracket, end, PHONE


def _runs(text: str) -> Iterator[re.Match]:
    """Longest runs of letters, digits and signs that hold a digit, found from the digits."""
    free = 0
    digit = _DIGIT.search(text)
    while digit:
        start = digit.start()
        while start > free and text[start - 1] in _IN_RUN:
            start -= 1
        m = _RUN.match(text, start)
        yield m
        free = m.end()
        digit = _DIGIT.search(text, free)


def proposals(text: str, base: list[Span] | None = None) -> list[Span]:
    """Candidates beyond the rules, overlapping and of several kinds for one string, where no base span is."""
    taken = Taken(base_spans(text)[0] if base is None else base)
    out: list[Span] = []
    for at in _AT.finditer(text):
        if not _DOMAIN_STARTS.match(text, at.end()):
            continue
        sign = at.start() - 1
        start = end = sign - 1 if text[sign - 1 : sign].isspace() else sign
        while start and end - start <= 64 and text[start - 1] in _BEFORE_AT:
            start -= 1
        if m := _SPELLED.match(text, start):
            out.append((start, m.end(), EMAIL))
            # a full stop may end the sentence instead of going on with the domain
            for stop in _SENTENCE_END.finditer(text, start, m.end()):
                if short := _SPELLED.match(text, start, stop.start()):
                    out.append((start, short.end(), EMAIL))
    out += [(*m.span(), IP) for m in _MARKED_IP.finditer(text)]
    for m in _runs(text):
        run = m[0]
        if len(run) >= 16 and _LETTER.search(run):
            out.append((*m.span(), SECRET))
            # the run without signs at its ends, and what stands behind the name of an assignment or of a parameter
            named = _ASSIGNED.match(run)
            for start in {0, named.end() if named else 0}:
                for part in {run[start:], run[start:].strip("-_+/=~")}:
                    if len(part) >= 16 and part != run and _DIGIT.search(part):
                        at = m.start() + run.index(part, start)
                        out.append((at, at + len(part), SECRET))
    out = [c for c in out if not taken.overlaps(c[0], c[1])]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a >= 7:
            a = a - 1 if a and text[a - 1] == "(" else a
            for x, y in taken.free(a, b):
                if y - x >= 7:
                    out += _windows(text, x, y)
    return sorted(set(out))


def _class_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "#$%&/=_:" else 5


_CUES = (
    ("mail", "@", "contact", "write"), ("ip", "host", "server", "addr"), ("card", "visa", "pay", "credit"), ("tel", "phone", "call", "fax"),
    ("order", "invoice", "ref", "id", "no.", "version", "isbn", "date"), ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential"),
)
#: A name that says its value is a secret, at the end of what stands before the value.
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private|secret)[_-]?key|credentials?)[\"']?\s?[:=]\s?[\"']?$", re.I)
_CHANGE = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")
N_FEATURES = 34


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    a, b, kind = span
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = _GROUP.findall(s)
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 24].lower()
    f = [float(kind == k) for k in range(len(KINDS))]
    f += [len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)]
    f += [float(12 <= len(digits) <= 19 and luhn(digits)), len(set(digits)), s.count("."), s.count("-"), s.count(" "), float("(" in s and ")" in s)]
    f += [float(any(int(g[:9]) > 255 for g in groups)), float(s[:1] == "0"), float("dot" in s.lower()), float("at" in s.lower()), float(any(c in s for c in "(["))]
    f += [_class_of(text[a - 1 : a] if a else ""), _class_of(text[b : b + 1])]
    f += [float(any(c in before or (kind != SECRET and c in after) for c in cues)) for cues in _CUES]
    parts = _CHANGE.findall(s) if kind == SECRET else []
    letters = [p for p in parts if p.isalpha()]
    f += [len(parts) / len(s), max(map(len, letters), default=0), len(set(s)) / len(s), len(digits) / len(s), float(before.rstrip("\"' ")[-1:] in ("=", ":"))]
    return f


@dataclass
class Redactor:
    """Trees and, by kind, the least score that is redacted."""

    trees: Boosting | None
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, both by start then kind."""
        return next(self.spans_of([text]))

    def spans_of(self, texts: list[str], most: int = 4096) -> Iterator[tuple[list[Span], list[Span]]]:
        """``spans`` of every text; proposals of several texts, some ``most`` of them, are scored at once."""
        waiting: list[tuple[list[Span], list[Span]]] = []
        rows: list[list[float]] = []
        scores: list[np.ndarray] = []

        def flush() -> Iterator[tuple[list[Span], list[Span]]]:
            if rows:
                scores.append(self.trees.predict(np.array(rows, float)))
            every = np.concatenate(scores) if scores else np.zeros(0)
            at = 0
            for base, new in waiting:
                yield base, self._chosen(base, new, every[at : at + len(new)])
                at += len(new)
            waiting.clear(), rows.clear(), scores.clear()

        for text in texts:
            base, _ = base_spans(text)
            new = [] if self.trees is None else proposals(text, base)
            for c in new:
                rows.append(features(text, c))
                if len(rows) == most:
                    scores.append(self.trees.predict(np.array(rows, float)))
                    rows.clear()
            waiting.append((base, new))
            if scores:
                yield from flush()
        yield from flush()

    def _chosen(self, base: list[Span], new: list[Span], scores: np.ndarray) -> list[Span]:
        """Base spans and, of overlapping proposals at their threshold or over it, the best scored."""
        every, taken = list(base), Taken([])
        for k in np.argsort(-scores, kind="stable"):
            a, b, kind = new[k]
            if scores[k] >= self.thresholds[kind] and not taken.overlaps(a, b):
                taken.add(a, b)
                every.append((a, b, kind))
        every.sort(key=lambda s: (s[0], s[2], s[1]))
        return every


_OTHER_NAMES = ("commit", "sha1", "etag", "build", "checksum", "revision", "file", "digest")
_OTHER_FORMS = ('{} = "{}"', "{}={}", "{}: {}", "?page=2&{}={}&x=1", "export {}={}")
_SECRET_NAMES = ('api_key = "{}"', "password: {}", 'access_key: "{}"', "auth token {}", "Bearer {}", "pwd = '{}'")
_ASSIGNED_NAMES = ("token", "secret", "password", "AWS_SECRET_KEY", "GITHUB_TOKEN", "api_key", "CLIENT_SECRET", "access_token", "DB_PASSWORD")
_ASSIGNED_FORMS = ("{}=", "export {}=", "https://api.example/v1?{}=", "?page=2&{}=")


def _rewritten(text: str, span: Span, rng: np.random.Generator, other: str) -> Iterator[tuple[str, Span, bool]]:
    """Snippets with the span in another format in its own context, where it then lies, and whether it is right there.

    ``other`` is some other span of its kind.
    """
    a, b, kind = span
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    pick = lambda *x: x[rng.integers(len(x))]
    made: list[tuple[str, str, str, int, bool]] = []  # before, the span, behind, kind, right
    if kind == EMAIL:
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", "."))
        local, _, host = s.partition("@")
        made.append(("", local + at + host.replace(".", dot), "", kind, True))
    if kind == IP:
        made.append(("", s.replace(".", pick("[.]", "(.)", " dot ", "[dot]", " . ")), "", kind, True))
        made.append(("", s.rsplit(".", 1)[0].replace(".", ". ") + f". {int(rng.integers(256, 999))}", "", kind, False))
    if kind == CARD:
        sep = pick(".", "  ", " - "[:2], ". ")
        made.append(("", sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), "", kind, True))
        near = _NOT_DIGIT.sub("", other) if rng.random() < 0.8 else str(rng.integers(10**6, 10**9))
        made.append((near + " ", s, "", kind, True))
        made.append(("", s, " " + near, kind, True))
        # a window that passes the check by chance across groups
        made.append(("", " ".join(digits[i : i + 5] for i in range(0, len(digits), 5)), " " + str(rng.integers(10**3, 10**7)), kind, False))
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + rng.integers(9)) % 10)
        made.append(("", " ".join(str(rng.integers(10 ** int(rng.integers(1, 6)))) for _ in range(9)) + " " + wrong, "", kind, False))
    if kind == PHONE and len(digits) >= 10:
        area, mid, end = digits[-10:-7], digits[-7:-4], digits[-4:]
        made.append(("", pick(f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}"), "", kind, True))
        made.append(("", digits[-10:], "", kind, False))
        made.append(("", f"{digits[-8:-4]}-{digits[-4:-2]}-{digits[-2:]}", "", kind, False))
    if kind == SECRET:
        before, _, behind = pick(*_SECRET_NAMES).partition("{}")
        made.append((before, s, behind, kind, True))
        # many keys begin with a few letters that tell who gave them; so do other digests
        short = "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 5))) + pick("_", "-")
        for front in ("", short):
            made.append((pick(*_ASSIGNED_FORMS).format(pick(*_ASSIGNED_NAMES)), front + s, pick("", "&lang=en", "\n"), kind, True))
            name, _, end = pick(*_OTHER_FORMS).replace("{}", pick(*_OTHER_NAMES), 1).partition("{}")
            made.append((name, front + s, end, kind, False))
        words = re.findall(r"[A-Za-z]{3,}", text[:2000])[:400] or ["word"]
        made.append((pick(before, ""), "-".join(pick(*words) for _ in range(5)) + f"-{int(rng.integers(1, 3000))}", behind, kind, False))
    for before, new, behind, k, right in made:
        head = text[max(0, a - 60) : a]
        # a secret's own name doesn't stay before the new one
        head = head if kind != SECRET else _NAMED.sub("", head).rstrip("\"' ") + " "
        head += before
        yield head + new + behind + text[b + (kind == SECRET) : b + 60], (len(head), len(head) + len(new), k), right


def _signature(text: str, span: Span) -> tuple[int, ...]:
    return tuple(map(len, _GROUP.findall(text[span[0] : span[1]])))


def examples(sample: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and the text's number of the proposals that a sample of texts gives."""
    rng = np.random.default_rng(seed)
    found = [base_spans(t)[0] for t in sample]
    forms = {_signature(t, s) for t, base in zip(sample, found) for s in base if s[2] == CARD}
    pools: list[list[tuple[int, Span]]] = [[] for _ in KINDS]
    rows: list[tuple[list[float], int, int, int]] = []
    for i, (text, base) in enumerate(zip(sample, found)):
        for s in base:
            pools[s[2]].append((i, s))
        for c in proposals(text, base):
            right = c[2] == SECRET and bool(_NAMED.search(text[max(0, c[0] - 40) : c[0]]))
            if right:
                pools[SECRET].append((i, c))
            # a free window built like a card of the sample may well be one
            if c[2] != CARD or _signature(text, c) not in forms:
                rows.append((features(text, c), int(right), c[2], i))
    for pool in pools:
        for n, (i, s) in enumerate(pool):
            j, o = pool[(n + 1) % len(pool)]
            for snippet, at, right in _rewritten(sample[i], s, rng, sample[j][o[0] : o[1]]):
                for c in proposals(snippet):
                    if c[0] < at[1] and at[0] < c[1]:
                        rows.append((features(snippet, c), int(right and c == at), c[2], i))
    x, y, kinds, where = zip(*rows) if rows else ((), (), (), ())
    return np.array(x, float).reshape(len(rows), N_FEATURES), np.array(y, float), np.array(kinds, np.int64), np.array(where, np.int64)


def thresholds_of(scores: np.ndarray, labels: np.ndarray, kinds: np.ndarray, precision: float, weight: float = 20.0) -> tuple[float, ...]:
    """By kind, the least score from which on proposals reach the precision; 2, which no score reaches, if none does.

    A kind's precision is shrunk towards that of all kinds at the same score, which counts
    like ``weight`` proposals, so kinds with few proposals follow the others smoothly.
    """
    order = np.argsort(-scores, kind="stable")
    s, t, k = scores[order], labels[order], kinds[order]
    every = np.cumsum(t) / np.arange(1, len(t) + 1)
    out = []
    for kind in range(len(KINDS)):
        own = k == kind
        right, n = np.cumsum(t * own), np.cumsum(own)
        ok = (right + weight * every) / (n + weight) >= precision
        # scores in between proposals change nothing: a threshold is one of the kind's own scores
        ends = np.flatnonzero(ok & own & (np.append(np.diff(s), -1) < 0))
        out.append(max(0.6, float(s[ends[-1]])) if len(ends) else 2.0)
    return tuple(out)


def fit_texts(sample: list[str], precision: float = 0.99, seed: int = 11) -> Redactor:
    """Trees on the proposals of four fifths of the texts, thresholds on those of the rest."""
    x, y, kinds, where = examples(sample, seed)
    held = where % 5 == 4
    if len(set(y[~held].tolist())) < 2 or not held.any():
        return Redactor(None, (2.0,) * len(KINDS))
    trees = Boosting().fit(x[~held], y[~held])
    scores, limits = trees.predict(x[held]), list(thresholds_of(trees.predict(x[held]), y[held], kinds[held], precision))
    if limits[SECRET] <= 1:
        # secrets have no rule beside the trees, and few examples: theirs is the middle of the gap below the last one
        below = scores[(kinds[held] == SECRET) & (scores < limits[SECRET])]
        limits[SECRET] = max(0.6, (limits[SECRET] + float(below.max(initial=0.0))) / 2)
    return Redactor(trees, tuple(limits))


def fit(
    docs: DataFrame,
    text_col: str = "text",
    *,
    most_docs: int = 4000,
    most_chars: int = 20_000,
    precision: float = 0.99,
    seed: int = 11,
) -> Redactor:
    """Fits trees and thresholds on a bounded sample of documents.

    About ``most_docs`` documents of at most ``most_chars`` characters that hold an
    ``@`` or a digit are drawn by a hash of the text, each distinct text once; a run on
    the same documents draws the same. Without spans in the sample nothing is added to
    the rules.
    """
    Scratch(docs.sparkSession, "pii")
    texts = docs.select(docs[text_col].cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= most_chars))
    n = texts.count()
    hashed = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    drawn = texts.where(hashed / float(1 << 30) < min(1.0, most_docs / max(n, 1))).distinct()
    # equal texts are drawn together: of distinct ones there may be more than asked for, never more than twice as many
    sample = sorted(r[0] for r in drawn.orderBy(hashed, "text").limit(2 * most_docs).collect())
    return fit_texts(sample, precision, seed)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, redactor: Redactor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text, in code points.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the
    base spans as kind:start:end by start then kind), spans (all spans, joined likewise)
    and n_spans, the number of all spans. Null and empty texts have no spans; every row
    gives a row, with repeated and null ids as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(redactor)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((BASE_KINDS + 1, len(batch)), np.int64)
            sums, joined = [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, (base, every) in enumerate(shared.value.spans_of(texts)):
                for s in base:
                    counts[s[2], i] += 1
                counts[BASE_KINDS, i] = len(every)
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(every))
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in counts[:BASE_KINDS]), pa.array(sums, pa.string()), pa.array(joined, pa.string()), pa.array(counts[BASE_KINDS])], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, redactor: Redactor, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns and rows, with personal data in texts replaced.

    A column of text lengths, where there is one, follows the changed texts. Null texts
    stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(redactor)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sizes = batch.column(length).to_pylist() if length is not None else []
            for i, (_, spans) in enumerate(shared.value.spans_of([t or "" for t in texts])):
                if spans:
                    texts[i] = redacted(texts[i], spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes:
                columns[length] = pa.array(sizes, batch.schema.field(length).type)
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
