"""A factor configuration: YAML over defaults, questions about it, and the tasks that it describes.

    factor_type_weights: {time_series: 0.5, ...}
    common: {time_series: [{name, category, class, default_params}, ...], ...}
    idiosyncratic: {by_sector: {<sector>: {<type>: [...]}}, by_asset: {...}}
    fixed_pairs: {<sector>: [[a, b], ...]}
    backtest: {initial_capital, transaction_cost}

A file's mappings are laid over the defaults key by key; its lists and plain values replace them. A factor of an asset stands
before the one of its sector, and that before the common one of the same name. Small and on the driver by nature.
"""

from __future__ import annotations

import copy
import importlib
from collections.abc import Callable
from pathlib import Path
from typing import Any

from .engine_api import KINDS, Mode, Task

DEFAULTS: dict[str, Any] = {
    "factor_type_weights": {"time_series": 0.5, "cross_sectional": 0.35, "pair_trading": 0.15},
    "common": {
        "time_series": [
            {"name": "HurstExponent", "category": "trend", "default_params": {"window": 100, "scale": 2.0}},
            {"name": "AMIHUDFactor", "category": "liquidity", "default_params": {"short": 2, "long": 8}},
        ],
        "cross_sectional": [],
        "pair_trading": [{"name": "CopulaPairFactor", "category": "copula", "default_params": {"window": 60}}],
    },
    "idiosyncratic": {"by_sector": {}, "by_asset": {}},
    "fixed_pairs": {},
    "backtest": {"initial_capital": 1e7, "transaction_cost": 0.001},
}


def laid_over(base: Any, top: Any) -> Any:
    if isinstance(base, dict) and isinstance(top, dict):
        return base | {k: laid_over(base.get(k), v) for k, v in top.items()}
    return copy.deepcopy(base if top is None else top)


class Config:
    """Read when first asked; a file that isn't there leaves the defaults."""

    def __init__(self, path: str | None = None):
        self.path = path
        self._all: dict | None = None

    def load(self) -> dict:
        if self._all is None:
            found = {}
            if self.path and Path(self.path).exists():
                import yaml

                found = yaml.safe_load(Path(self.path).read_text(encoding="utf-8")) or {}
                if not isinstance(found, dict):
                    raise ValueError(f"{self.path} isn't a mapping")
            self._all = laid_over(DEFAULTS, found)
        return self._all

    def reload(self) -> dict:
        self._all = None
        return self.load()

    def get(self, key: str, default: Any = None) -> Any:
        """The value at a dotted path."""
        at: Any = self.load()
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def factors(self, kind: str | None = None, sector: str | None = None, asset: str | None = None, category: str | None = None) -> list[dict]:
        """Common factors and those of the sector and asset, one for each name, the narrowest."""
        own = self.load()["idiosyncratic"]
        scopes = [self.load()["common"], own["by_sector"].get(sector) or {}, own["by_asset"].get(asset) or {}]
        found: dict[str, dict] = {}
        for scope in scopes:
            for k in [kind] if kind else list(KINDS):
                found |= {f["name"]: f | {"type": k} for f in scope.get(k) or []}
        return [copy.deepcopy(f) for f in found.values() if category in (None, f.get("category"))]

    def categories(self, kind: str | None = None) -> list[str]:
        return sorted({f["category"] for f in self.factors(kind) if "category" in f})

    def factor(self, name: str, sector: str | None = None, asset: str | None = None) -> dict | None:
        return next((f for f in self.factors(None, sector, asset) if f["name"] == name), None)

    def params(self, name: str, given: dict | None = None, sector: str | None = None, asset: str | None = None) -> dict:
        """Parameters of a factor: common defaults, then the sector's, the asset's and the given ones."""
        out: dict = {}
        for scope in ({}, {"sector": sector}, {"sector": sector, "asset": asset}):
            out |= (self.factor(name, **scope) or {}).get("default_params") or {}
        return out | (given or {})

    def pairs(self) -> dict[str, list[tuple[str, str]]]:
        return {sector: [tuple(p) for p in listed] for sector, listed in self.load()["fixed_pairs"].items()}

    def task(self, mode: Mode | str, sector: str | None = None, **options) -> Task:
        """A task of all configured factors that the mode runs, its parameters, capital and cost; options go first."""
        mode = Mode(mode)
        kind = "pair_trading" if mode is Mode.PAIR else "cross_sectional" if mode in (Mode.SINGLE_XS, Mode.MULTI_XS) else "time_series"
        names = options.pop("factors", None) or [f["name"] for f in self.factors(kind, sector)]
        given = options.pop("params", {})
        if mode is Mode.PAIR and "pairs" not in options:
            options["pairs"] = [p for s, listed in self.pairs().items() if sector in (None, s) for p in listed]
        for f in self.factors(None, sector):
            if f["name"] in names and "class" in f:
                register_path(f["name"], f["type"], f["class"])
        money = {"capital": float(self.get("backtest.initial_capital")), "cost": float(self.get("backtest.transaction_cost"))}
        return Task(mode, names, {n: self.params(n, given.get(n), sector) for n in names}, **(money | options))


def register_path(name: str, kind: str, path: str) -> None:
    """A factor by the dotted path of its builder, imported when it first runs. A name that is registered stays as it is."""

    def build(*args, **params):
        KINDS[kind][name] = f = loaded(path)
        return f(*args, **params)

    KINDS[kind].setdefault(name, build)


def loaded(path: str) -> Callable:
    module, _, name = path.rpartition(".")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ImportError(f"no factor at {path!r}") from e
