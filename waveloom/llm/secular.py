"""Rank-one updates of symmetric eigendecompositions, for several of them at once.

An update turns Q diag(d) Q' into the decomposition of Q (diag(d) + z z') Q'. The new eigenvalues
are the roots of the secular equation 1 + sum z_j^2 / (d_j - t) = 0, one in each gap of d and one
beyond it. Components that z doesn't touch, and all but one direction of equal eigenvalues, are
deflated: they stay as they are. Arrays have the decomposition in front: d is (m, n) and ascending,
q is (m, n, n) with eigenvectors in columns.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Steps of the root finder; each root is held in a bracket that shrinks at every step.
STEPS = 80


def roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pole, tau): root i of each row is d[pole] + tau, so that differences to d lose no digits.

    d is strictly ascending and z2 positive. Each step takes the rational function with the two
    poles around the root that has the value and both slopes of the secular one (the middle way),
    and halves the bracket where that leaves it.
    """
    m, n = d.shape
    last = np.tile(np.arange(n) == n - 1, m)
    left = np.arange(n)[None, :] <= np.arange(n)[:, None]  # left[i, j]: pole j lies at or below root i
    total = z2.sum(1, keepdims=True)
    width = np.concatenate([d[:, 1:] - d[:, :-1], total], 1)
    beyond = np.concatenate([z2[:, 1:], np.zeros((m, 1))], 1)
    with np.errstate(all="ignore"):
        middle = 1 + (z2[:, None, :] / (d[:, None, :] - d[:, :, None] - width[:, :, None] / 2)).sum(2)
        up = (middle < 0) & ~last.reshape(m, n)  # the root lies nearer to the pole above
        pole = np.arange(n) + up
        base = np.take_along_axis(d, pole, 1)
        lo = np.where(up, -width / 2, np.where(middle < 0, width / 2, 0.0))
        hi = np.where(up, 0.0, np.where(middle < 0, width, width / 2))
        # first the root of the function of both poles, with all else as it is in the middle
        c = middle + (z2 - beyond) * 2 / width
        b = np.where(up, -beyond, z2) * width
        a = (z2 + beyond) + np.where(up, -c, c) * width
        s = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        first = np.where(last.reshape(m, n), z2 / c, np.where(a > 0, 2 * b / (a + s), (a - s) / (2 * c)))
        first = np.where(up, np.where(a < 0, 2 * b / (a - s), (a + s) / (2 * c)), first)
        tau = np.where((first > lo) & (first < hi), first, (lo + hi) / 2).ravel()
        lo, hi = lo.ravel(), hi.ravel()
        below, above = (d - base).ravel(), (np.concatenate([d[:, 1:], d[:, -1:] + total], 1) - base).ravel()  # the poles around each root
        gap, weight = (d[:, None, :] - base[:, :, None]).reshape(-1, n), np.repeat(z2, n, 0)
        left = np.tile(left, (m, 1)).astype(np.float64)
        at = np.arange(m * n)  # the roots that are still sought
        out = tau.copy()
        for _ in range(STEPS):
            delta = gap - tau[:, None]
            terms = weight / delta
            f = 1 + terms.sum(1)
            size = np.abs(terms).sum(1)
            lo, hi = np.where(f < 0, tau, lo), np.where(f > 0, tau, hi)
            open_ = ~((np.abs(f) <= 4 * EPS * n * (1 + size)) | (hi - lo <= 2 * EPS * np.abs(tau)))
            out[at] = tau
            if not open_.any():
                break
            if 2 * np.count_nonzero(open_) < len(at):
                at, tau, lo, hi, below, above, last, f = (x[open_] for x in (at, tau, lo, hi, below, above, last, f))
                gap, weight, left, delta, terms = (x[open_] for x in (gap, weight, left, delta, terms))
                open_ = np.ones(len(at), bool)
            slope = terms / delta
            rise = np.einsum("ij,ij->i", slope, left)
            every = slope.sum(1)
            x, y = below - tau, above - tau
            c = f - x * rise - y * (every - rise)
            a = (x + y) * f - x * y * every
            b = x * y * f
            s = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - s) / (2 * c), 2 * b / (a + s))
            # beyond the last pole nothing lies above: one pole with the value and slope
            step = np.where(last, x + x * x * rise / (f - x * rise), step)
            new = tau + step
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
            tau = np.where(open_, new, tau)
    return pole, out.reshape(m, n)


def _vectors(d: np.ndarray, pole: np.ndarray, tau: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of diag(d) + z z' in columns, from its roots.

    z is worked out anew as the vector whose roots are exactly these, so that the eigenvectors are
    orthogonal to working precision however near roots and poles lie.
    """
    m, n = d.shape
    base = d[np.arange(m)[:, None], pole]
    delta = (d[:, :, None] - base[:, None, :]) - tau[:, None, :]  # d_j - root_i
    gap = d[:, :, None] - d[:, None, :]
    np.einsum("mjj->mj", gap)[:] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        # product over i of (root_i - d_j) / (d_i - d_j), the factor of i = j without its divisor
        ratio = delta / gap
    own = np.einsum("mjj->mj", ratio)
    own[:] = -np.einsum("mjj->mj", delta)
    size = np.sqrt(np.abs(np.prod(ratio, 2)))
    v = np.copysign(size, z)[:, :, None] / delta
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _one(d: np.ndarray, q: np.ndarray, z: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """One update with deflation: of each run of equal eigenvalues a reflection leaves one direction, and untouched ones stay."""
    d, q, z = d.copy(), q.copy(), z.copy()
    n, i = len(d), 0
    while i < n:
        j = i + 1
        while j < n and d[j] - d[i] <= tol:
            j += 1
        if j - i > 1 and np.count_nonzero(z[i:j]) > 1:
            u = z[i:j].copy()
            size = np.linalg.norm(u)
            u[-1] += np.copysign(size, u[-1])
            u /= np.linalg.norm(u)
            q[:, i:j] -= 2 * np.outer(q[:, i:j] @ u, u)
            z[i:j] -= 2 * u * (u @ z[i:j])
            z[i : j - 1] = 0
        i = j
    live = np.flatnonzero(z * z > tol * EPS + EPS * EPS * (z @ z))
    if len(live):
        pole, tau = roots(d[None, live], z[None, live] ** 2)
        v = _vectors(d[None, live], pole, tau, z[None, live])[0]
        q[:, live] = q[:, live] @ v
        d[live] = d[live][pole[0]] + tau[0]
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def updated(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decompositions (d, q) after adding v v' to each; v is (m, n). Those that deflate are done one by one, the others together."""
    z = np.matmul(v[:, None, :], q)[:, 0, :]
    scale = np.maximum(np.abs(d).max(1), (z * z).sum(1))
    tol = 8 * EPS * scale
    plain = (np.diff(d, axis=1) > tol[:, None]).all(1) & (z * z > (tol * EPS + EPS * EPS * (z * z).sum(1))[:, None]).all(1) & (scale > 0)
    out_d, out_q = np.empty_like(d), np.empty_like(q)
    at = np.flatnonzero(plain)
    if len(at):
        pole, tau = roots(d[at], z[at] ** 2)
        out_q[at] = q[at] @ _vectors(d[at], pole, tau, z[at])
        out_d[at] = np.take_along_axis(d[at], pole, 1) + tau
    for i in np.flatnonzero(~plain):
        out_d[i], out_q[i] = _one(d[i], q[i], z[i], tol[i]) if scale[i] > 0 else (d[i], q[i])
    return out_d, out_q
