"""Driver-side optimisers over dense parameter vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAX_MOVE = 2.0


def preconditioned_step(params: np.ndarray, gradient: np.ndarray, inverse_hessian: np.ndarray, step: float | np.ndarray) -> np.ndarray:
    """A step against the gradient, scaled per parameter; directions are clipped to +-2."""
    return params - step * np.clip(gradient * inverse_hessian, -MAX_MOVE, MAX_MOVE)


def lbfgs(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 50, memory: int = 10, tolerance: float = 1e-8, inverse_hessian: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Limited-memory BFGS that needs gradients only: a step is halved until the slope along the direction is no longer
    clearly positive (it hasn't passed the minimum by much). ``inverse_hessian`` preconditions the first direction."""
    x, g = start.copy(), gradient(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) < tolerance:
            break
        d = -_product(g, moves, inverse_hessian(x) if inverse_hessian else None)
        slope = float(d @ g)
        if slope >= 0:
            d, slope, moves = -g, -float(g @ g), []
        t = 1.0
        for _ in range(30):
            new = x + t * d
            ng = gradient(new)
            if np.isfinite(ng).all() and float(d @ ng) <= -0.5 * slope:
                break
            t /= 2
        s, y = new - x, ng - g
        if float(s @ y) > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y, 1 / float(s @ y))]
        x, g = new, ng
    return x


def _product(g: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray, float]], diagonal: np.ndarray | None) -> np.ndarray:
    q, back = g.copy(), []
    for s, y, r in reversed(moves):
        a = r * float(s @ q)
        q -= a * y
        back.append(a)
    if diagonal is not None:
        q *= diagonal
    elif moves:
        s, y, _ = moves[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y, r), a in zip(moves, reversed(back), strict=True):
        q += s * (a - r * float(y @ q))
    return q
