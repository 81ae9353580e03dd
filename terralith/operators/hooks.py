"""Regularisers, validators and optimisers added by name.

A regulariser is a DataFrame-to-DataFrame function of a model's vertices or parameters that gives
one row with a ``penalty``; a validator maps (start, now) to one row with ``passed`` and
``worst``; an optimiser takes callables of value and gradient over a parameter vector. What is
added is used exactly like what is built in; built-in names cannot be replaced. Kernels are added
by ``forward.register_kernel``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators import inversion as inv

Regulariser = Callable[[DataFrame], DataFrame]
Validator = Callable[[DataFrame, DataFrame], DataFrame]


class Optimiser(Protocol):
    def __call__(self, value: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int) -> np.ndarray: ...


def _reference(parameters: DataFrame) -> DataFrame:
    """Half the squared distance of parameters(dof_id, p) from p0."""
    return inv.reference_penalty(parameters, 1.0).select(F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


def _bounded(value, gradient, start, lower, upper, rounds):
    return inv.Bounded(value, gradient, lower, upper, rounds=rounds).minimise(start)


def _newton(value, gradient, start, lower, upper, rounds):
    return inv.newton_cg(value, gradient, start, lower, upper, rounds=rounds)


_BUILT_IN: dict[str, dict[str, Callable]] = {"regulariser": {"reference": _reference}, "validator": {}, "optimiser": {"bounded": _bounded, "newton_cg": _newton}}
_ADDED: dict[str, dict[str, Callable]] = {kind: {} for kind in _BUILT_IN}


def register(kind: str, name: str, fn: Callable) -> None:
    """Add a ``regulariser``, ``validator`` or ``optimiser``; a name added before is replaced."""
    if kind not in _BUILT_IN:
        raise ValueError(f"no hook {kind}")
    if name in _BUILT_IN[kind]:
        raise ValueError(f"{name} is a built-in {kind}")
    _ADDED[kind][name] = fn


def _find(kind: str, name: str) -> Callable:
    found = _ADDED[kind].get(name) or _BUILT_IN[kind].get(name)
    if found is None:
        raise ValueError(f"no {kind} {name}")
    return found


def penalties(model: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(term, penalty) of the named regularisers times their weights; an empty model has penalty 0."""
    rows = [_find("regulariser", n)(model).select(F.lit(n).alias("term"), (F.coalesce("penalty", F.lit(0.0)) * weight).alias("penalty")) for n, weight in weights.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def checks(start: DataFrame, now: DataFrame, names: list[str]) -> DataFrame:
    """(place, check, passed, worst) of the named validators, in their order."""
    rows = [_find("validator", n)(start, now).select(F.lit(i).alias("place"), F.lit(n).alias("check"), "passed", "worst") for i, n in enumerate(names, 1)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def minimise(name: str, value: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The named optimiser's minimum, put within the bounds."""
    found = _find("optimiser", name)(value, gradient, np.asarray(start, float), lower, upper, rounds)
    return np.clip(found, lower, upper)
