"""The registered queries and the SQL that they are held against."""

from __future__ import annotations

import importlib

#: Modules with QUERIES: name -> (function of (spark, sf_dir), SQL or None).
MODULES: tuple[str, ...] = ("paid_after", "cleaning", "aggregates", "windows", "joins", "setops", "scalars", "volume", "listed", "procedures", "network", "predictive", "serve", "feed", "network_features")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        for name, pair in importlib.import_module(f"claimlens.plans.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"{name} is registered twice")
            out[name] = pair
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _all().items() if q}
