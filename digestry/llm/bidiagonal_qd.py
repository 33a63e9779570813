"""Singular values and right singular vectors of a small matrix by a bidiagonal qd solver.

Householder reflections make the matrix bidiagonal, dqds finds the squared singular values of each
unreduced block without subtractions that cancel, and twisted factorisations give the vectors of the
wanted ones, which the reflections take back.
"""

from __future__ import annotations

EPS = 2.0**-52
CLOSE = 1e-3  # vectors of squared values closer than this, relatively, are checked and made orthogonal


def bidiagonalise(matrix):
    """(diagonal, superdiagonal, right reflections) of ``U.T @ matrix @ V`` for a square matrix."""
    import numpy as np

    a = np.array(matrix, np.float64)
    n = len(a)
    right = []
    for k in range(n):
        _reflect(a[k:, k:])
        if k < n - 2:
            right.append((k + 1, _reflect(a[k:, k + 1 :].T)))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflect(a):
    """Reflect the rows of ``a`` (a view) so that its first column is zero below the first entry; the unit normal."""
    import numpy as np

    x = a[:, 0].copy()
    scale = np.abs(x).max(initial=0)
    if not scale or not np.abs(x[1:]).max(initial=0):
        return None
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    a -= np.outer(2 * v, v @ a)
    a[1:, 0] = 0
    return v


def blocks(diagonal, above):
    """(start, end) of the parts between negligible superdiagonal entries."""
    import numpy as np

    norm = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    cuts = np.nonzero(np.abs(above) <= EPS * norm)[0] + 1
    return list(zip([0, *cuts], [*cuts, len(diagonal)], strict=True))


def dqds(diagonal, above) -> list[float]:
    """Squared singular values of an upper bidiagonal matrix, largest first.

    Shifts are lower bounds of the smallest value (Newton's, from a pass without shift), or an estimate from the
    last two rows where the pass with it stays positive; a shift that fails is not used."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, shift = [], 0.0
    while q:
        n = len(q)
        if n == 1:
            found.append(q.pop() + shift)
            continue
        if e[-1] <= (EPS * EPS) * (shift + q[-1]) or e[-1] <= EPS * EPS * shift:
            found.append(q.pop() + shift)
            e.pop()
            continue
        split = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (q[k] + shift)), None)
        if split is not None and split < n - 2:
            found += [x + shift for x in _squares(q[split + 1 :], e[split + 1 :])]
            q, e = q[: split + 1], e[:split]
            continue
        plain = _pass(q, e, 0.0)
        least = 1 / sum(1 / d for d in plain[2]) if min(plain[2]) > 0 else 0.0
        # the smaller eigenvalue of the last two rows bounds the smallest from above; near the end it is close to it
        a, b, c = q[-2], e[-1], q[-1]
        guess = 2 * a * c / ((a + b + c) + max((a + b + c) ** 2 - 4 * a * c, 0.0) ** 0.5) if a + b + c > 0 else 0.0
        for s in (guess * (1 - 1e-10), 0.98 * guess, least * (1 - 4 * n * EPS)):
            done = _pass(q, e, s) if s > 0 else plain
            if min(done[2]) >= 0:
                break
        else:
            done, s = plain, 0.0
        q, e = done[0], done[1]
        shift += max(s, 0.0)
    return sorted(found, reverse=True)


def _squares(q, e) -> list[float]:
    return dqds([x**0.5 for x in q], [x**0.5 for x in e])


def _pass(q, e, shift):
    """One differential qd transform: new q, new e, and its pivots (negative if the shift was too large)."""
    new_q, new_e, pivots = [], [], []
    d = q[0] - shift
    for k in range(len(e)):
        pivots.append(d)
        new_q.append(d + e[k])
        if new_q[k] <= 0:
            if d == 0 and e[k] == 0:
                new_e.append(0.0)
                d = q[k + 1] - shift
                continue
            pivots.append(-1.0)
            return new_q, new_e, pivots
        ratio = q[k + 1] / new_q[k]
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    pivots.append(d)
    new_q.append(d)
    return new_q, new_e, pivots


def twisted_vector(diagonal, above, square: float):
    """Unit right singular vector of an unreduced bidiagonal block for one squared singular value.

    B'B - square = L+ D+ L+' from the top and U- D- U-' from the bottom; both meet at the row where the
    twisted pivot is smallest."""
    import numpy as np

    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    norm = max(np.abs(diagonal).max(), np.abs(above).max())
    tiny = EPS * EPS * norm
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    d, low = a * a, above / a[:-1]
    least = EPS * EPS * square + np.finfo(float).tiny

    def solid(x):
        return x if abs(x) > least else -least

    top, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -square
    for k in range(n - 1):
        plus = solid(d[k] + s[k])
        top[k] = d[k] * low[k] / plus
        s[k + 1] = top[k] * low[k] * s[k] - square
    bottom, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - square
    for k in range(n - 2, -1, -1):
        minus = solid(d[k] * low[k] ** 2 + p[k + 1])
        ratio = d[k] / minus
        bottom[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - square
    twist = int(np.argmin(np.abs(s + p + square)))
    z = np.zeros(n)
    z[twist] = 1
    for k in range(twist - 1, -1, -1):
        z[k] = -top[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -bottom[k] * z[k]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def _orthogonal(vectors, squares, tri):
    """Vectors of close values made orthogonal by inverse iteration on the block's tridiagonal matrix."""
    import numpy as np

    m = len(tri)
    random = np.random.default_rng(0)
    out = []
    for z, x in zip(vectors, squares, strict=True):
        near = [v for v, y in zip(out, squares, strict=False) if abs(y - x) <= CLOSE * abs(x)]
        if near:
            basis = np.array(near)
            if np.abs(basis @ z).max() > 8 * EPS * m:
                for attempt in range(4):
                    z = z - basis.T @ (basis @ z)
                    if np.linalg.norm(z) < 0.5:
                        z = random.standard_normal(m)
                        z -= basis.T @ (basis @ z)
                    z = np.linalg.solve(tri - (x + EPS * squares[0] * (attempt + 1)) * np.eye(m), z / np.linalg.norm(z))
                    z /= np.linalg.norm(z)
                z -= basis.T @ (basis @ z)
                z /= np.linalg.norm(z)
        out.append(z)
    return out


def leading(matrix, count: int):
    """(squared singular values, right singular vectors as rows), the ``count`` largest; values at rounding level are left out."""
    import numpy as np

    n = len(matrix)
    scale = float(np.abs(matrix).max(initial=0))
    if not n or not scale:
        return np.zeros(0), np.zeros((0, n))
    diagonal, above, right = bidiagonalise(np.asarray(matrix) / scale)
    pairs = [(x, a, b, rank) for a, b in blocks(diagonal, above) for rank, x in enumerate(dqds(diagonal[a:b], above[a : b - 1]))]
    pairs.sort(key=lambda p: (-p[0], p[1], p[3]))
    pairs = [p for p in pairs[:count] if p[0] > (EPS * n) ** 2 * pairs[0][0]]
    out = np.zeros((len(pairs), n))
    for a, b in {(a, b) for _, a, b, _ in pairs}:
        mine = [i for i, p in enumerate(pairs) if p[1] == a]
        squares = [pairs[i][0] for i in mine]
        part = np.zeros((b - a, b - a))
        np.fill_diagonal(part, diagonal[a:b])
        np.fill_diagonal(part[:, 1:], above[a : b - 1])
        found = [twisted_vector(diagonal[a:b], above[a : b - 1], x) for x in squares]
        out[mine, a:b] = _orthogonal(found, squares, part.T @ part)
    for at, v in reversed(right):
        if v is not None:
            out[:, at:] -= np.outer(2 * (out[:, at:] @ v), v)
    return np.array([p[0] for p in pairs]) * scale * scale, out
