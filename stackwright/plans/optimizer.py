"""Stochastic gradient descent over Spark aggregates.

The driver holds only the parameter vector; every evaluation of the objective is one Spark job over the
minibatch, handed in as a function x -> (loss, gradient).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

Objective = Callable[[np.ndarray, int], tuple[float, np.ndarray]]


@dataclass
class RunningSum:
    """Weighted mean of the latest value of each key; all weights fade with each update. When the number of keys
    changes, the mean so far stays as history: it counts with the weight it had, less the share of keys seen since."""

    decay: float = 1.0
    values: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)
    n_keys: int = 0
    history: tuple[float, np.ndarray, np.ndarray] | None = None

    def expect(self, n_keys: int) -> None:
        """The number of keys from now on."""
        if n_keys != self.n_keys and self.total_weight() > 0:
            self.history = self.total_weight(), self.mean(), self.mean_square()
            self.values, self.weights = {}, {}
        self.n_keys = n_keys

    def set(self, key: int, value: np.ndarray, weight: float = 1.0) -> None:
        for k in self.weights:
            self.weights[k] *= self.decay
        self.values[key], self.weights[key] = value, weight
        if self.history:
            self.history = None if len(self.values) >= self.n_keys else (self.decay * self.history[0], *self.history[1:])

    def _old(self) -> float:
        return self.history[0] * (self.n_keys - len(self.values)) / self.n_keys if self.history else 0.0

    def total_weight(self) -> float:
        return sum(self.weights.values()) + self._old()

    def mean(self) -> np.ndarray:
        old = self._old() * self.history[1] if self.history else 0.0
        return (sum((w * self.values[k] for k, w in self.weights.items()), old)) / self.total_weight()

    def mean_square(self) -> np.ndarray:
        old = self._old() * self.history[2] if self.history else 0.0
        return (sum((w * self.values[k] ** 2 for k, w in self.weights.items()), old)) / self.total_weight()


def preconditioner(mean_square: np.ndarray, weight: float, prior_weight: float = 10.0, most: float = 1000.0) -> np.ndarray:
    """Scales of the coordinates from running second moments of their gradients: 1 for the flattest. The moments are drawn to
    their mean as by prior_weight observations, and held within a range."""
    middle = mean_square.mean()
    f = (middle * prior_weight + mean_square * weight) / (weight + prior_weight) if weight > 1 else np.full_like(mean_square, middle)
    least = max(f.min(), f.max() / most)
    return np.sqrt(least / np.maximum(least, f)) if least > 0 else np.ones_like(f)


def fit_with_slope(x: np.ndarray, y: np.ndarray, slope: float, degree: int = 2) -> np.ndarray:
    """Polynomial through (0, y[0]) with the given slope at 0, least squares over the rest."""
    rest = y[1:] - y[0] - slope * x[1:]
    powers = np.arange(2, degree + 1)
    coefs, *_ = np.linalg.lstsq(x[1:, None] ** powers, rest, rcond=None)
    return np.concatenate([[y[0], slope], coefs])


def find_lipschitz(f: Objective, x: np.ndarray, batch: int, loss: float, grad: np.ndarray, start: float, most: int = 20, scale: np.ndarray | float = 1.0) -> float:
    """The smallest L seen for which a step of 1/L lowers the loss by |g|^2 / (2 L) at least. The last ten
    probes are fitted to guess the next one; otherwise L is doubled, or halved while it holds. scale: a preconditioner,
    whose square turns the gradient into the step."""
    g2 = float((grad * grad * scale**2).sum())
    if g2 == 0:
        return start
    probes: deque[tuple[float, float]] = deque(maxlen=10)
    best, value = None, start
    for _ in range(most):
        after = f(x - scale**2 * grad / value, batch)[0]
        probes.append((1 / value, after))
        if after <= loss - 0.5 * g2 / value:
            best = value if best is None else min(best, value)
            following = value / 2
            if any(1 / p[0] <= following for p in probes if p[0] > 1 / value):
                return best
        else:
            if best is not None:
                return best
            steps = np.array([0.0] + [p[0] for p in probes])
            losses = np.array([loss] + [p[1] for p in probes])
            curve = fit_with_slope(steps, losses, -g2)[2]
            following = max(2 * value, 2 * curve / g2) if np.isfinite(curve) else 2 * value
        value = following
    return best if best is not None else value


@dataclass
class AverageGradient:
    """Averages the latest gradient of each minibatch; the step is learn_rate / L. saga: the average before the step, with the
    change of this minibatch's gradient whole: without bias. precondition: coordinates are scaled by the running second
    moments of their gradients, anew whenever L is searched for. n_batches: of the training set, which may change between
    steps; the average so far then fades as minibatches come by."""

    learn_rate: float = 1.0
    momentum: float = 1.0
    lipschitz: float = 1.0
    search_every: int = 1
    saga: bool = False
    precondition: bool = False
    n_batches: int = 0
    history: RunningSum = field(init=False)
    scale: np.ndarray | float = 1.0

    def __post_init__(self):
        self.history = RunningSum(self.momentum)

    def step(self, f: Objective, prior: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, batch: int, turn: int) -> tuple[np.ndarray, dict]:
        loss, grad = f(x, batch)
        prior_loss, prior_grad = prior(x)
        self.history.expect(self.n_batches)
        before, average = self.history.values.get(batch), self.history.mean() if self.history.total_weight() > 0 else None
        self.history.set(batch, grad)
        if turn % self.search_every == 0:
            if self.precondition:
                self.scale = preconditioner(self.history.mean_square(), self.history.total_weight())
            both = lambda y, b: (f(y, b)[0] + prior(y)[0], None)
            self.lipschitz = find_lipschitz(both, x, batch, loss + prior_loss, grad + prior_grad, self.lipschitz, scale=self.scale)
        # a minibatch that comes for the first time has no change yet
        like = average + grad - before if self.saga and before is not None else self.history.mean()
        move = like + prior_grad
        after = x - self.learn_rate / self.lipschitz * self.scale**2 * move
        return after, {"iteration": turn, "batch": batch, "loss": loss + prior_loss, "lipschitz": self.lipschitz, "step_size": float(np.linalg.norm(after - x)), "grad_size": float(np.linalg.norm(move)), "scale_min": float(np.min(self.scale))}


@dataclass
class MomentumGradient:
    """Gradient descent with momentum. average: the gradient is a moving average, in which the last one has so much. adapt: the learn
    rate is over a Lipschitz constant, which grows by `increase` a turn and is searched for every search_every turns."""

    learn_rate: float = 0.1
    momentum: float = 0.9
    average: float = 0.0
    adapt: bool = False
    lipschitz: float = 1.0
    increase: float = 1.0
    search_every: int = 1
    velocity: np.ndarray | None = None
    mean: np.ndarray | None = None

    def step(self, f: Objective, prior, x: np.ndarray, batch: int, turn: int) -> tuple[np.ndarray, dict]:
        loss, grad = f(x, batch)
        prior_loss, prior_grad = prior(x)
        whole = move = grad + prior_grad
        if self.average > 0:
            move = self.mean = (1 - self.average) * whole + (0 if self.mean is None else self.average * self.mean)
        rate = self.learn_rate
        if self.adapt:
            self.lipschitz *= self.increase if turn else 1.0
            if turn % self.search_every == 0:
                both = lambda y, b: (f(y, b)[0] + prior(y)[0], None)
                self.lipschitz = find_lipschitz(both, x, batch, loss + prior_loss, whole, self.lipschitz, 20 if turn == 0 else 3)
            rate = self.learn_rate / self.lipschitz
        self.velocity = self.momentum * (0 if self.velocity is None else self.velocity) - rate * move
        return x + self.velocity, {"iteration": turn, "batch": batch, "loss": loss + prior_loss, "step_size": float(np.linalg.norm(self.velocity)), "grad_size": float(np.linalg.norm(whole)), "lipschitz": self.lipschitz}


ALGORITHMS = {"average": AverageGradient, "momentum": MomentumGradient}


def batch_order(n_batches: int, seed: int) -> Iterator[tuple[int, int]]:
    """(epoch, batch) without end: each epoch is a new order, by seed and epoch."""
    epoch = 0
    while True:
        for b in np.random.default_rng([seed, epoch]).permutation(max(1, n_batches)).tolist():
            yield epoch, b
        epoch += 1


def minimise(f: Objective, prior, x: np.ndarray, n_batches: int, iterations: int, algorithm=None, seed: int = 0, bounds: tuple[float, float] | None = None, each: Callable[[dict, np.ndarray], None] | None = None) -> tuple[np.ndarray, list[dict]]:
    """The main loop: one minibatch a turn; `each` may write statistics or a checkpoint."""
    algorithm = algorithm or AverageGradient()
    stats, order = [], batch_order(n_batches, seed)
    for turn in range(iterations):
        epoch, batch = next(order)
        x, row = algorithm.step(f, prior, x, batch, turn)
        if bounds:
            x = np.clip(x, *bounds)
        stats.append(row | {"epoch": epoch})
        if each:
            each(stats[-1], x)
    return x, stats
