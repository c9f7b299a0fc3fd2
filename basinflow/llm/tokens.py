"""Exact token ids of a BPE vocabulary file, with a word cache where its rules allow one."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Folder of the vocabulary files; a parameter of every operator that uses them.
DEFAULT_VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules of the vocabulary whose pieces ``WordTokenizer`` knows.
_KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_KNOWN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def has_known_rules(path: str) -> bool:
    """Whether a vocabulary file normalises and splits texts by the known rules, and its added tokens are marked by <|."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    return spec.get("normalizer") == _KNOWN_NORMALIZER and spec.get("pre_tokenizer") == _KNOWN_SPLIT and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and all("<|" in t["content"] for t in added)


_LOADED: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its word cache serves all the worker's tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's rules lower-case a text, split it at white space and at
    boundaries of letters, digits and other signs, and merge within those pieces
    only. So in a text of plain characters (see ``_PLAIN``: signs that no
    normalisation changes and whose lower case is one sign) the ids of a run
    between spaces depend on that run alone, and runs are looked up in a cache.
    Any other text, and any that may hold an added token, goes to the tokenizer, as do
    all texts of a vocabulary with other rules.
    """

    #: The vocabulary's own pieces, for plain characters in lower case.
    _PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
    _PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")

    def __init__(self, path: str, most_cached: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Ids of pieces, and of runs of several pieces.
        self.cache: dict[str, bytes] = {}
        self.most_cached = most_cached
        self.cached_words = has_known_rules(path)
        size = self.tokenizer.get_vocab_size()
        self._raw = [int(i).to_bytes(4, "little") for i in range(size)]
        # the vocabulary's letters for bytes: printable ones stand for themselves, the rest follow from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self._letters = {b: 256 + i for i, b in enumerate(others)}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece in lower case: merges alone are left to do."""
        known = self.cache.get(piece)
        if known is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
            raw = self._raw
            known = self.cache[piece] = b"".join([raw[t.id] for t in self.model.tokenize(letters)])
        return known

    def _learn(self, runs: set[str]) -> None:
        """Cache the ids of runs, piece by piece."""
        cache, piece = self.cache, self._piece
        for run in runs:
            if run.isalpha():
                piece(run)
            else:
                parts = self._PIECE.findall(run)
                if len(parts) == 1:
                    piece(run)
                else:
                    cache[run] = b"".join([piece(p) for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, exactly those of the tokenizer."""
        out: list[bytes] = [b""] * len(texts)
        slow = [i for i, t in enumerate(texts) if not self.cached_words or "<|" in t or not self._PLAIN.fullmatch(t)]
        for i, ids in zip(slow, self._encode([texts[i] for i in slow]) if slow else ()):
            out[i] = ids
        other, plain = set(slow), []
        for i, t in enumerate(texts):
            if i in other:
                continue
            plain.append((i, t.lower().split()))
        for at in range(0, len(plain), 64):
            group = plain[at : at + 64]
            if len(self.cache) > self.most_cached:
                self.cache.clear()
            missing = set().union(*(runs for _, runs in group)).difference(self.cache)
            if missing:
                self._learn(missing)
            get = self.cache.__getitem__
            for i, runs in group:
                out[i] = b"".join(map(get, runs))
        return out
