"""Run-length Burrows-Wheeler index of equally long strings, and matching statistics streamed against it.

The suffixes of all strings are sorted once, by doubling; what stays is the transform's
runs: a run's byte, its first row, where it leads, the text positions of its first and
last row, and the least document of the window that its rows begin with (a run is cut
where that changes). A query is read from its last byte to its first. While the byte
read is that of the present run, the match is extended by following it. Otherwise it
moves to the end of the nearest run of that byte above or below: the positions sampled
there tell which of the two keeps the longer match. All queries go in step.
"""

from __future__ import annotations

import numpy as np

#: Stands beyond a string's ends; no byte of UTF-8 text.
PAD = 0xFF
NONE = np.iinfo(np.int64).max


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the keys (ties by place), the rank of each from 1, and whether all differ."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    number = np.cumsum(new)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = number
    return order, ranks, int(number[-1]) == len(keys)


class RunIndex:
    """Index of the rows of a byte matrix, each of a document; windows are of ``span`` bytes."""

    def __init__(self, strings: np.ndarray, docs: np.ndarray, span: int):
        self.span = span
        m, width = strings.shape
        side = width + 1  # every string is followed by a pad
        text = np.full((m, side), PAD, np.uint8)
        text[:, :width] = strings
        n = m * side
        ahead = np.zeros((m, side + 8), np.int64)
        ahead[:, :side] = text
        keys = np.zeros((m, side), np.uint64)
        for j in range(8):
            keys = (keys << np.uint64(8)) | ahead[:, j : j + side].astype(np.uint64)
        order, ranks, done = _ranks(keys.ravel())
        depth, least = 8, max(8, 1 << (span.bit_length() - 1))
        half = ranks
        while depth < side:
            if depth == least:
                half = ranks
            if done and depth >= least:
                break
            later = np.zeros((m, side), np.int64)
            later[:, : side - depth] = ranks.reshape(m, side)[:, depth:]
            order, ranks, done = _ranks(ranks * (n + 1) + later.ravel())
            depth *= 2
        column = order % side
        # rows whose suffix begins with a whole window, and where the window differs from the row's before
        whole = column <= width - span
        beyond = np.minimum(order + span - least, n - 1)
        first, second = half[order], half[beyond]
        new = np.ones(n, bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | ~whole[1:] | ~whole[:-1]
        starts = np.flatnonzero(new)
        low = np.minimum.reduceat(np.where(whole, docs[order // side], NONE), starts)
        label = np.repeat(low, np.diff(np.append(starts, n)))
        byte = np.where(column > 0, text.ravel()[order - 1], PAD)
        cut = np.ones(n, bool)
        cut[1:] = (byte[1:] != byte[:-1]) | (label[1:] != label[:-1])
        self.start = np.flatnonzero(cut)
        self.length = np.diff(np.append(self.start, n))
        self.byte = byte[self.start].astype(np.int64)
        self.label = label[self.start]
        self.first = order[self.start]
        self.last = order[self.start + self.length - 1]
        runs = len(self.start)
        # runs by byte: where each leads, and the nearest of a byte
        by = np.argsort(self.byte, kind="stable")
        self.of_byte = self.byte[by] * runs + by
        self.by = by
        before = np.cumsum(self.length[by]) - self.length[by]
        counts = np.bincount(self.byte, weights=self.length, minlength=256).astype(np.int64)
        head = np.cumsum(counts) - counts
        smaller = np.cumsum(np.bincount(text.ravel(), minlength=256)) - np.bincount(text.ravel(), minlength=256)
        self.leads = np.empty(runs, np.int64)
        self.leads[by] = before - head[self.byte[by]] + smaller[self.byte[by]]
        padded = np.concatenate([text.ravel(), np.full(span, PAD, np.uint8)])
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, span)

    def _shared(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bytes that the text shares at two places, up to the span."""
        differ = self.windows[at] != self.windows[other]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.span)

    def _jump(self, byte: np.ndarray, run: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, text position and length of the match after a byte that isn't the run's; the length is 0 if the text lacks it."""
        runs = len(self.start)
        down = np.searchsorted(self.of_byte, byte * runs + run)
        up = self.by[down - 1]
        has_up = (down > 0) & (self.byte[up] == byte)
        down = self.by[np.minimum(down, runs - 1)]
        has_down = (self.byte[down] == byte) & (down > run)
        share = np.full((2, len(byte)), -1)
        for k, (has, ends) in enumerate(((has_up, self.last[up]), (has_down, self.first[down]))):
            share[k, has] = 0
            tried = np.flatnonzero(has & (length > 0))
            share[k, tried] = self._shared(at[tried], ends[tried])
        above = share[0] >= share[1]
        row = np.where(above, self.leads[up] + self.length[up] - 1, self.leads[down])
        position = np.where(above, self.last[up], self.first[down]) - 1
        return row, position, np.where(has_up | has_down, np.minimum(share.max(axis=0), length) + 1, 0)

    def seen(self, queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Bits of each query's windows (bit 0: the first) that begin in a string of a smaller document."""
        lanes, width = queries.shape
        row = np.zeros(lanes, np.int64)
        run = np.zeros(lanes, np.int64)
        at = np.full(lanes, self.first[0])
        length = np.zeros(lanes, np.int64)
        bits = np.zeros(lanes, np.uint32)
        for column in range(width - 1, -1, -1):
            byte = queries[:, column].astype(np.int64)
            same = np.flatnonzero((self.byte[run] == byte) & (byte != PAD))
            other = np.flatnonzero((self.byte[run] != byte) & (byte != PAD))
            now = np.zeros(lanes, np.int64)
            now[same] = length[same] + 1
            row[same] = self.leads[run[same]] + row[same] - self.start[run[same]]
            at[same] -= 1
            if len(other):
                to, position, matched = self._jump(byte[other], run[other], at[other], length[other])
                found = matched > 0
                row[other[found]], at[other[found]], now[other[found]] = to[found], position[found], matched[found]
            # a match longer than a window tells no more
            length = np.minimum(now, self.span)
            run = np.searchsorted(self.start, row, side="right") - 1
            if column <= width - self.span:
                hit = (length == self.span) & (self.label[run] < docs)
                bits |= hit.astype(np.uint32) << np.uint32(column)
        return bits
