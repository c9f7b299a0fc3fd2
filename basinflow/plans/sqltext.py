"""Pieces of the oracles' SQL."""

from __future__ import annotations

from collections.abc import Sequence


def number(x: float) -> str:
    """A double literal, read from text so that no digit is lost."""
    return f"'{x!r}'::DOUBLE"


def bin_index(value: str, edges: Sequence[float]) -> str:
    """0-based bin of a double expression, -1 off the edges' range or missing."""
    n = len(edges) - 1
    whens = " ".join(f"WHEN {value} >= {number(edges[i])} THEN {i}" for i in range(n - 1, -1, -1))
    return f"(CASE WHEN {value} IS NULL OR isnan({value}) OR {value} < {number(edges[0])} OR {value} > {number(edges[-1])} THEN -1 {whens} END)"


def clipped_index(value: str, edges: Sequence[float]) -> str:
    """Bin of a double expression, off-range values in the nearest edge bin."""
    n = len(edges) - 1
    whens = " ".join(f"WHEN {value} >= {number(edges[i])} THEN {i}" for i in range(n - 1, 0, -1))
    return f"(CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL {whens} ELSE 0 END)"


def bin_centre(index: str, edges: Sequence[float]) -> str:
    """Centre of a bin."""
    return "list_extract([" + ", ".join(number((a + b) / 2) for a, b in zip(edges, edges[1:])) + f"], {index} + 1)"


def wrap(angle: str) -> str:
    """An angle brought to [-180, 180), as a positive remainder."""
    a = f"({angle} + 180.0)"
    return f"(CASE WHEN fmod({a}, 360.0) < 0 THEN fmod(fmod({a}, 360.0) + 360.0, 360.0) ELSE fmod({a}, 360.0) END - 180.0)"


def components(occupied: str, nx: int, ny: int, periodic: bool, keys: Sequence[str] = ()) -> str:
    """CTE list: cells of ``occupied`` (keys, xi, yi) to (keys, xi, yi, component)."""
    k = "".join(f"{c}, " for c in keys)
    same = "".join(f" AND a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    step = "(a.xi = b.xi AND abs(a.yi - b.yi) = 1) OR (a.yi = b.yi AND abs(a.xi - b.xi) = 1)"
    if periodic:
        step += f" OR (a.yi = b.yi AND abs(a.xi - b.xi) = {nx - 1}) OR (a.xi = b.xi AND abs(a.yi - b.yi) = {ny - 1})"
    ak = "".join(f"a.{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""
adjacent AS (SELECT {ak} a.xi * {ny} + a.yi AS src, b.xi * {ny} + b.yi AS dst FROM {occupied} a JOIN {occupied} b ON ({step}){same}),
reach AS (SELECT {k} xi * {ny} + yi AS cell, xi * {ny} + yi AS seen FROM {occupied}
  UNION SELECT {"".join(f"r.{c}, " for c in keys)} r.cell, a.dst FROM reach r JOIN adjacent a ON r.seen = a.src{"".join(f" AND r.{c} IS NOT DISTINCT FROM a.{c}" for c in keys)}),
rooted AS (SELECT {k} cell, min(seen) AS root FROM reach GROUP BY {k} cell),
numbered AS (SELECT {k} cell // {ny} AS xi, cell % {ny} AS yi, dense_rank() OVER ({part}ORDER BY root) - 1 AS component FROM rooted)"""


def dihedral(vector: str, atoms: Sequence[int]) -> str:
    """SELECT-ready dihedral over a CTE column of flat coordinates; see the query for the CTE chain."""
    a, b, c, d = atoms
    p = lambda i, k: f"{vector}[{3 * i + k + 1}]::DOUBLE"
    b1, b2, b3 = ([f"({p(y, k)} - {p(x, k)})" for k in range(3)] for x, y in ((a, b), (b, c), (c, d)))
    cross = lambda u, v: [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    dot = lambda u, v: f"({u[0]} * {v[0]} + {u[1]} * {v[1]} + {u[2]} * {v[2]})"
    n1, n2 = cross(b1, b2), cross(b2, b3)
    # atan2(|b2| b1 . (b2 x b3), (b1 x b2) . (b2 x b3)) is the same angle without normalising
    return f"-degrees(atan2(sqrt({dot(b2, b2)}) * {dot(b1, n2)}, {dot(n1, n2)}))"


def eigenvalues(a: str, b: str, c: str, d: str, e: str, f: str, source: str, keep: str) -> str:
    """SELECT of ``keep`` and the eigenvalues l1 >= l2 >= l3 of the symmetric matrix (a, d, e; d, b, f; e, f, c) of each row, in closed form."""
    return f"""SELECT {keep}, q + 2 * p * cos(t) AS l1, 3 * q - (q + 2 * p * cos(t)) - (q + 2 * p * cos(t + 2 * pi() / 3)) AS l2, q + 2 * p * cos(t + 2 * pi() / 3) AS l3 FROM (
SELECT *, acos(greatest(-1.0, least(1.0, ((({a} - q) * (({b} - q) * ({c} - q) - {f} * {f}) - {d} * ({d} * ({c} - q) - {f} * {e}) + {e} * ({d} * {f} - ({b} - q) * {e})) / (p * p * p)) / 2))) / 3 AS t FROM (
SELECT *, sqrt((({a} - q) ** 2 + ({b} - q) ** 2 + ({c} - q) ** 2 + 2 * ({d} * {d} + {e} * {e} + {f} * {f})) / 6) AS p FROM (
SELECT *, ({a} + {b} + {c}) / 3 AS q FROM ({source}))))"""


def best_plane(source: str, key: str, vector: str, atoms: Sequence[int]) -> str:
    """SELECT of key and the unit normal (x, y, z) of some atoms' best-fit plane, to the side of the first three."""
    at = lambda i, k: f"{vector}[{3 * i + k + 1}]::DOUBLE"
    mean = [f"(({' + '.join(at(i, k) for i in atoms)}) / {len(atoms)})" for k in range(3)]
    part = lambda k, m: " + ".join(f"({at(i, k)} - m{k}) * ({at(i, m)} - m{m})" for i in atoms)
    turned = [[f"({at(j, k)} - {at(atoms[0], k)})" for k in range(3)] for j in atoms[1:3]]
    cross = lambda u, v: [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    side = cross(*turned)
    means = f"SELECT *, {', '.join(f'{m} AS m{k}' for k, m in enumerate(mean))} FROM ({source})"
    scatter = f"SELECT {key}, {', '.join(f'{x} AS s{k}' for k, x in enumerate(side))}, {part(0, 0)} AS a, {part(1, 1)} AS b, {part(2, 2)} AS c, {part(0, 1)} AS d, {part(0, 2)} AS e, {part(1, 2)} AS f FROM ({means})"
    solved = eigenvalues("a", "b", "c", "d", "e", "f", scatter, f"{key}, s0, s1, s2, a, b, c, d, e, f")
    rows = [["(a - l3)", "d", "e"], ["d", "(b - l3)", "f"], ["e", "f", "(c - l3)"]]
    picks = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sizes = [" + ".join(f"{x} * {x}" for x in p) for p in picks]
    found = f"SELECT *, {', '.join(f'{z} AS z{k}' for k, z in enumerate(sizes))} FROM ({solved})"
    chosen = [f"CASE WHEN z0 >= z1 AND z0 >= z2 THEN {picks[0][k]} WHEN z1 >= z2 THEN {picks[1][k]} ELSE {picks[2][k]} END AS v{k}" for k in range(3)]
    vector_of = f"SELECT {key}, s0, s1, s2, {', '.join(chosen)} FROM ({found})"
    unit = ", ".join(f"v{k} * CASE WHEN v0 * s0 + v1 * s1 + v2 * s2 < 0 THEN -1 ELSE 1 END / sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS {n}" for k, n in enumerate("xyz"))
    return f"SELECT {key}, {unit} FROM ({vector_of})"


def least_rmsd(source: str, key: str, vector: str, atoms: int) -> str:
    """SELECT of key and the least root mean square distance of each structure, moved and turned, from that of the smallest key.

    With H the scatter between two centred structures and s its singular values, that
    is sqrt((|A|^2 + |B|^2 - 2 (s1 + s2 +- s3)) / n), minus if det H is negative.
    """
    at = lambda v, i, k: f"{v}[{3 * i + k + 1}]::DOUBLE"
    n = range(atoms)
    mean = lambda v, k: f"({' + '.join(at(v, i, k) for i in n)}) / {atoms}"
    both = f"SELECT {key}, {vector} AS u, (SELECT {vector} FROM ({source}) ORDER BY {key} LIMIT 1) AS w FROM ({source})"
    means = f"SELECT *, {', '.join(f'{mean(v, k)} AS {v}{k}' for v in 'uw' for k in range(3))} FROM ({both})"
    h = {(j, k): " + ".join(f"({at('u', i, j)} - u{j}) * ({at('w', i, k)} - w{k})" for i in n) for j in range(3) for k in range(3)}
    size = lambda v: " + ".join(f"({at(v, i, k)} - {v}{k}) ** 2" for i in n for k in range(3))
    scatter = f"SELECT {key}, {size('u')} AS nu, {size('w')} AS nw, {', '.join(f'{x} AS h{j}{k}' for (j, k), x in h.items())} FROM ({means})"
    gram = lambda j, k: f"(h0{j} * h0{k} + h1{j} * h1{k} + h2{j} * h2{k})"
    det = "h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20)"
    solved = eigenvalues(gram(0, 0), gram(1, 1), gram(2, 2), gram(0, 1), gram(0, 2), gram(1, 2), scatter, f"{key}, nu, nw, {det} AS det")
    sum_ = "sqrt(greatest(l1, 0)) + sqrt(greatest(l2, 0)) + sign(det) * sqrt(greatest(l3, 0))"
    return f"SELECT {key}, sqrt(greatest(0, (nu + nw - 2 * ({sum_})) / {atoms})) AS rmsd FROM ({solved})"


def laid_on_first(source: str, key: str, vector: str, atoms: int) -> str:
    """SELECT of key, atom, x, y and z: each structure moved and turned onto that of the smallest key.

    The quaternion of the best turn solves (N - v) q = 0, with N Horn's 4x4 matrix and v
    its largest eigenvalue s1 + s2 +- s3; it is the largest column of that matrix's adjugate.
    """
    at = lambda v, i, k: f"{v}[{3 * i + k + 1}]::DOUBLE"
    n = range(atoms)
    mean = lambda v, k: f"({' + '.join(at(v, i, k) for i in n)}) / {atoms}"
    both = f"SELECT {key}, {vector} AS u, (SELECT {vector} FROM ({source}) ORDER BY {key} LIMIT 1) AS w FROM ({source})"
    means = f"SELECT *, {', '.join(f'{mean(v, k)} AS {v}{k}' for v in 'uw' for k in range(3))} FROM ({both})"
    h = {(j, k): " + ".join(f"({at('u', i, j)} - u{j}) * ({at('w', i, k)} - w{k})" for i in n) for j in range(3) for k in range(3)}
    keep = f"{key}, u, u0, u1, u2, w0, w1, w2"
    scatter = f"SELECT {keep}, {', '.join(f'{x} AS h{j}{k}' for (j, k), x in h.items())} FROM ({means})"
    gram = lambda j, k: f"(h0{j} * h0{k} + h1{j} * h1{k} + h2{j} * h2{k})"
    hs = ", ".join(f"h{j}{k}" for j in range(3) for k in range(3))
    det = "h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20)"
    solved = eigenvalues(gram(0, 0), gram(1, 1), gram(2, 2), gram(0, 1), gram(0, 2), gram(1, 2), scatter, f"{keep}, {hs}, {det} AS det")
    top = f"SELECT *, sqrt(greatest(l1, 0)) + sqrt(greatest(l2, 0)) + sign(det) * sqrt(greatest(l3, 0)) AS v FROM ({solved})"
    horn = {
        (0, 0): "h00 + h11 + h22", (0, 1): "h12 - h21", (0, 2): "h20 - h02", (0, 3): "h01 - h10",
        (1, 1): "h00 - h11 - h22", (1, 2): "h01 + h10", (1, 3): "h20 + h02",
        (2, 2): "h11 - h00 - h22", (2, 3): "h12 + h21", (3, 3): "h22 - h00 - h11",
    }
    entries = f"SELECT *, {', '.join(f'{x}' + (' - v' if i == j else '') + f' AS n{i}{j}' for (i, j), x in horn.items())} FROM ({top})"
    m = lambda i, j: f"n{min(i, j)}{max(i, j)}"

    def minor(i: int, j: int) -> str:
        a, b = [r for r in range(4) if r != i], [c for c in range(4) if c != j]
        two = lambda p, q: f"({m(a[1], p)} * {m(a[2], q)} - {m(a[1], q)} * {m(a[2], p)})"
        sign = "-" if (i + j) % 2 else ""
        return f"{sign}({m(a[0], b[0])} * {two(b[1], b[2])} - {m(a[0], b[1])} * {two(b[0], b[2])} + {m(a[0], b[2])} * {two(b[0], b[1])})"

    adjugate = f"SELECT {keep}, {', '.join(f'{minor(i, j)} AS c{i}{j}' for i in range(4) for j in range(4))} FROM ({entries})"
    best = "greatest(" + ", ".join(f"abs(c{i}{i})" for i in range(4)) + ")"
    column = [f"CASE {' '.join(f'WHEN abs(c{j}{j}) = {best} THEN c{i}{j}' for j in range(4))} END AS p{i}" for i in range(4)]
    picked = f"SELECT {keep}, {', '.join(column)} FROM ({adjugate})"
    unit = f"SELECT {keep}, {', '.join(f'p{i} / sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3) AS q{i}' for i in range(4))} FROM ({picked})"
    turn = [
        ["q0*q0 + q1*q1 - q2*q2 - q3*q3", "2 * (q1*q2 - q0*q3)", "2 * (q1*q3 + q0*q2)"],
        ["2 * (q1*q2 + q0*q3)", "q0*q0 - q1*q1 + q2*q2 - q3*q3", "2 * (q2*q3 - q0*q1)"],
        ["2 * (q1*q3 - q0*q2)", "2 * (q2*q3 + q0*q1)", "q0*q0 - q1*q1 - q2*q2 + q3*q3"],
    ]
    part = lambda k: f"(u[3 * a.i + {k + 1}]::DOUBLE - u{k})"
    places = ", ".join(f"{' + '.join(f'({turn[j][k]}) * {part(k)}' for k in range(3))} + w{j} AS {c}" for j, c in enumerate("xyz"))
    return f"SELECT {key}, a.i::INT AS atom, {places} FROM ({unit}) CROSS JOIN range({atoms}) a(i)"
