"""Limited-memory BFGS for the small models that are fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 6, tolerance: float = 1e-6) -> np.ndarray:
    """Minimum of a smooth function that returns its value and gradient (two-loop recursion, halving line search)."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = grad.copy()
        held = []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            held.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(steps, reversed(held), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, float(grad @ d)
        while True:
            new_x = x - step * d
            new_value, new_grad = f(new_x)
            if new_value <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new_x - x, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        settled = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        x, value, grad = new_x, new_value, new_grad
        if settled:
            break
    return x
