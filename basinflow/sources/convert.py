"""Arrays of a trajectory as xyz text: a utility for data sets published as NPZ archives."""

from __future__ import annotations

import hashlib

import numpy as np

# Element symbols by atomic number, from 1 on.
SYMBOLS = ("H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca")


def npz_to_xyz(source: str, target: str, *, stride: int = 1, sha256: str | None = None) -> int:
    """Writes the frames of an archive with z (numbers), R (frames, atoms, 3) and, if present, E; returns their number.

    Every ``stride``-th frame is written. With ``sha256`` the archive's checksum must be that.
    """
    if stride < 1:
        raise ValueError(f"stride must be at least 1; got {stride}")
    if sha256 is not None:
        digest = hashlib.sha256()
        with open(source, "rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                digest.update(block)
        if digest.hexdigest() != sha256:
            raise ValueError(f"{source} has another checksum: {digest.hexdigest()}")
    with np.load(source, allow_pickle=False) as z:
        lacking = [k for k in ("z", "R") if k not in z]
        if lacking:
            raise ValueError(f"{source} lacks {lacking}")
        numbers, positions = z["z"].tolist(), z["R"]
        energies = np.asarray(z["E"]).reshape(-1) if "E" in z else None
    unknown = [n for n in numbers if not 1 <= n <= len(SYMBOLS)]
    if unknown:
        raise ValueError(f"no symbols for the atomic numbers {unknown}")
    symbols, written = [SYMBOLS[n - 1] for n in numbers], 0
    with open(target, "w", encoding="utf-8") as out:
        for i in range(0, len(positions), stride):
            energy = "" if energies is None else f" energy: {energies[i]:.8f}"
            out.write(f"{len(symbols)}\n# Step: {i}{energy}\n")
            out.writelines(f"{s} {x:.8f} {y:.8f} {w:.8f}\n" for s, (x, y, w) in zip(symbols, positions[i]))
            written += 1
    return written
