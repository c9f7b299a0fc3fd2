"""Maps and matrices as PNG pictures, made with the standard library alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

from . import palette

#: Overlays' and states' colours; more of them start anew.
OVERLAY_COLOURS = np.array([palette.BLACK, *palette.categories(3, 0.45)])
STATE_COLOURS = np.array(palette.categories(10))

#: Glyphs of 3 x 5 dots, a row of dots after the other.
_GLYPHS = {
    "0": "111 101 101 101 111", "1": "010 110 010 010 111", "2": "111 001 111 100 111", "3": "111 001 111 001 111", "4": "101 101 111 001 001",
    "5": "111 100 111 001 111", "6": "111 100 111 101 111", "7": "111 001 010 010 010", "8": "111 101 111 101 111", "9": "111 101 111 001 111",
    "A": "010 101 111 101 101", "B": "110 101 110 101 110", "C": "011 100 100 100 011", "D": "110 101 101 101 110", "E": "111 100 110 100 111",
    "F": "111 100 110 100 100", "G": "011 100 101 101 011", "H": "101 101 111 101 101", "I": "111 010 010 010 111", "J": "001 001 001 101 010",
    "K": "101 101 110 101 101", "L": "100 100 100 100 111", "M": "101 111 111 101 101", "N": "110 101 101 101 101", "O": "010 101 101 101 010",
    "P": "110 101 110 100 100", "Q": "010 101 101 110 011", "R": "110 101 110 101 101", "S": "011 100 010 001 110", "T": "111 010 010 010 010",
    "U": "101 101 101 101 111", "V": "101 101 101 101 010", "W": "101 101 111 111 101", "X": "101 101 010 101 101", "Y": "101 101 010 010 010",
    "Z": "111 001 010 100 111", ".": "000 000 000 000 010", "-": "000 000 111 000 000", "+": "000 010 111 010 000", "_": "000 000 000 000 111",
    "/": "001 001 010 100 100", ":": "000 010 000 010 000", "(": "010 100 100 100 010", ")": "010 001 001 001 010", " ": "000 000 000 000 000",
}
_UNKNOWN = "111 101 001 000 010"


def encode(rgb: np.ndarray) -> bytes:
    """An (height, width, 3) array of bytes as the bytes of a PNG file."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def write_png(path: str, rgb: np.ndarray) -> None:
    """Writes an array as a PNG file."""
    with open(path, "wb") as f:
        f.write(encode(rgb))


def text_mask(text: str, scale: int = 2) -> np.ndarray:
    """Dots of a text in capitals, unknown characters as a question mark."""
    parts = []
    for c in text.upper():
        rows = _GLYPHS.get(c, _UNKNOWN).split()
        parts += [np.array([[d == "1" for d in r] for r in rows]), np.zeros((5, 1), bool)]
    mask = np.concatenate(parts[:-1], axis=1) if parts else np.zeros((5, 0), bool)
    return np.repeat(np.repeat(mask, scale, axis=0), scale, axis=1)


def draw_text(rgb: np.ndarray, x: int, y: int, text: str, colour: Sequence[int] = palette.BLACK, scale: int = 2, width: int | None = None) -> None:
    """Draws a text with its upper left corner at a place; what is beyond the picture, or ``width``, is cut."""
    mask = text_mask(text, scale)[:, : width if width is None else max(0, width)]
    part = rgb[max(0, y) : y + mask.shape[0], max(0, x) : x + mask.shape[1]]
    part[mask[max(0, -y) :, max(0, -x) :][: part.shape[0], : part.shape[1]]] = colour


def coloured(values: np.ndarray) -> np.ndarray:
    """Colours of an array of values, white where there is none."""
    anchors = np.array(palette.SCALE, float)
    ok = np.isfinite(values)
    low, high = (values[ok].min(), values[ok].max()) if ok.any() else (0.0, 1.0)
    t = np.where(ok, (values - low) / ((high - low) or 1.0), 0.0) * (len(anchors) - 1)
    i = np.minimum(t.astype(int), len(anchors) - 2)
    rgb = anchors[i] + (t - i)[..., None] * (anchors[i + 1] - anchors[i])
    rgb[~ok] = 255
    return rgb.round().astype(np.uint8)


def _scaled(rgb: np.ndarray, least: int) -> np.ndarray:
    k = max(1, -(-least // max(rgb.shape[:2])))
    return np.repeat(np.repeat(rgb, k, axis=0), k, axis=1)


def picture_size(nx: int, ny: int, size: int = 600) -> tuple[int, int]:
    """Width and height of the picture of a map."""
    k = max(1, -(-size // max(nx, ny)))
    return nx * k, ny * k


def density_picture(counts: np.ndarray, log_scale: bool = True, centres: Sequence[tuple] = (), points: Sequence[tuple[float, ...]] = (), size: int = 600) -> np.ndarray:
    """Picture of counts[x, y]: y upwards, unsampled bins white, state centres and overlay points marked.

    Marks are (x, y, state) or (x, y, state, label) and (x, y) or (x, y, overlay), in
    fractions of the map.
    """
    values = np.where(counts > 0, np.log10(counts + 1) if log_scale else counts, np.nan).astype(float)
    rgb = _scaled(coloured(values.T[::-1]), size).copy()
    h, w, _ = rgb.shape

    def mark(x: float, y: float, colour: np.ndarray, r: int) -> tuple[int, int]:
        cx, cy = int(x * (w - 1)), int((1 - y) * (h - 1))
        rgb[max(0, cy - r) : cy + r + 1, max(0, cx - r) : cx + r + 1] = colour
        return cx, cy

    for x, y, *overlay in points:
        mark(x, y, OVERLAY_COLOURS[overlay[0] % len(OVERLAY_COLOURS) if overlay else 0], 1)
    for x, y, state, *label in centres:
        mark(x, y, np.array(palette.WHITE), 8)
        colour = STATE_COLOURS[state % len(STATE_COLOURS)]
        cx, cy = mark(x, y, colour, 6)
        if label:
            text = str(label[0])[:3]
            draw_text(rgb, cx - 2 * len(text) + 1, cy - 2, text, palette.legible(tuple(int(c) for c in colour)), 1)
    return rgb


def density_png(counts: np.ndarray, **options) -> bytes:
    """The picture of a map as the bytes of a PNG file; options as of ``density_picture``."""
    return encode(density_picture(counts, **options))


def _number(v: float) -> str:
    return f"{v:.3g}" if 1e-3 <= abs(v) < 1e5 or v == 0 else f"{v:.1e}"


def matrix_picture(panels: Sequence[np.ndarray], titles: Sequence[str] = (), labels: Sequence[str] = (), size: int = 240, most_annotated: int = 10) -> np.ndarray:
    """Square matrices side by side, missing entries white.

    ``titles`` stand above the panels, ``labels`` at their rows and below their columns;
    with labels, matrices of at most ``most_annotated`` rows show each entry's number.
    """
    parts = []
    for k, panel in enumerate(panels):
        m = np.asarray(panel, float)
        n = max(len(m), 1)
        annotated = bool(labels) and n <= most_annotated
        rgb = coloured(m)
        p = _scaled(rgb, max(size, 44 * n if annotated else 0)).copy()
        cell = p.shape[0] // n
        if annotated:
            for i in range(len(m)):
                for j in range(len(m)):
                    if np.isfinite(m[i, j]):
                        draw_text(p, j * cell + 2, i * cell + cell // 2 - 5, _number(m[i, j]), palette.legible(tuple(int(c) for c in rgb[i, j])), 2, cell - 3)
        if titles or labels:
            left = 4 + max((text_mask(s[:8]).shape[1] for s in labels), default=0)
            p = np.pad(p, ((18, 18 if labels else 0), (left, 0), (0, 0)), constant_values=255)
            draw_text(p, left, 4, titles[k] if k < len(titles) else "")
            # labels that would touch each other are left out
            if labels and cell >= 12:
                for i, s in enumerate(labels):
                    draw_text(p, 0, 18 + i * cell + cell // 2 - 5, s[:8])
                    draw_text(p, left + i * cell + 2, p.shape[0] - 14, s, width=cell - 3)
        parts += [p, np.full((p.shape[0], 12, 3), 255, np.uint8)]
    h = max(p.shape[0] for p in parts)
    return np.concatenate([np.pad(p, ((0, h - p.shape[0]), (0, 0), (0, 0)), constant_values=255) for p in parts[:-1]], axis=1)
