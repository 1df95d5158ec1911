"""Presets of a run: typed settings that can be laid over each other, and schedules as SQL expressions over the run's progress.

A schedule is a CASE expression, so that it can be read from a file, checked, and evaluated for one turn (monitor.schedule) or for
a whole table of turns (scheduled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwright.plans import monitor

#: Every setting with its default, which gives its type; None: any.
DEFAULTS: dict = {
    "pixels": 128, "directions": 500, "turns": 36, "shift_reach": 3.0, "shift_step": 1.0, "shift_sigma": 1.5, "symmetry": "c1",
    "batch_size": 200, "test_images": 200, "iterations": 1000, "sigma": 1.0, "prior_sigma": 10.0, "seed": 0,
    "algorithm": "average", "learn_rate": 0.5, "momentum": 1.0, "saga": False, "precondition": False, "search_every": 5,
    "sampling": False, "ess_scale": 5.0, "sample_prior": 0.05, "temperature": 1.0, "learn_noise": False, "noise_prior": 50.0, "white": True, "radius": None,
}

#: Named sets of settings, to be laid over the defaults in the order in which they are named.
PRESETS: dict[str, dict] = {
    "quick": {"pixels": 32, "directions": 60, "turns": 12, "iterations": 50, "batch_size": 50},
    "coarse_to_fine": {"radius": "CASE WHEN epoch < 1 THEN 0.25 WHEN epoch < 3 THEN 0.25 + 0.125 * epoch ELSE least(0.95, 0.5 + 0.05 * epoch) END"},
    "sampled": {"sampling": True, "ess_scale": 5.0, "temperature": 2.0},
    "averaged": {"algorithm": "average", "precondition": True, "saga": True},
    "momentum": {"algorithm": "momentum", "learn_rate": 0.1, "momentum": 0.9},
    "learned_noise": {"learn_noise": True, "white": False},
}


def settings(*names: str, files: list[str] | None = None, overrides: dict | None = None) -> dict:
    """The defaults with presets, then files, then overrides laid over them. Unknown names and other types are errors."""
    out = dict(DEFAULTS)
    for name in names:
        if name not in PRESETS:
            raise KeyError(f"unknown preset {name!r}")
        out = monitor.typed(DEFAULTS, out | PRESETS[name])
    return monitor.typed(DEFAULTS, monitor.parameters(out, *(files or []), overrides=overrides))


def scheduled(turns: DataFrame, schedules: dict[str, str]) -> DataFrame:
    """The turns of a run (epoch, iteration, ...) with what each schedule says for them."""
    return turns.withColumns({name: F.expr(text).cast("double") for name, text in schedules.items()})
