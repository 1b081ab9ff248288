"""Check registry: a check is a DataFrame -> DataFrame transform.

``register_check`` records name, category, mode, required input tables and
the facts function ``fn(catalog) -> DataFrame``; rendering to findings is
generic (``fleetlint.model.to_findings``).  Users add checks the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass
class CheckSpec:
    name: str
    category: str
    mode: str
    description: str
    fn: Callable
    needs: tuple[str, ...] = ()
    title: Callable[[], Column] | None = None
    detail: Callable[[], Column] | None = None
    remediation: Callable[[], Column] | None = None
    offline: bool = False          # has a schema-dump (analyze) variant
    tags: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, CheckSpec] = {}

# Category order used by run ordering (category, then name).
CATEGORIES = ["schema", "replication", "config", "extensions", "sql_patterns", "functions", "sequences"]


def register_check(name: str, category: str, mode: str = "scan", needs: Iterable[str] = (),
                   description: str = "", title=None, detail=None, remediation=None,
                   offline: bool = False):
    def deco(fn):
        REGISTRY[name] = CheckSpec(name, category, mode, description, fn, tuple(needs),
                                   title, detail, remediation, offline)
        return fn
    return deco


def select_checks(mode: str | None = None, categories: Iterable[str] | None = None,
                  exclude: Iterable[str] | None = None,
                  include_only: Iterable[str] | None = None) -> list[CheckSpec]:
    """Checks for a run: mode (own or ``both``), categories, exclude, and
    include-only (which beats exclude); ordered by category then name."""
    _load_all()
    cats = set(categories) if categories else None
    inc = set(include_only) if include_only else None
    exc = set(exclude) if exclude else set()
    out = []
    for spec in REGISTRY.values():
        if mode and spec.mode not in (mode, "both"):
            continue
        if cats is not None and spec.category not in cats:
            continue
        if inc is not None:
            if spec.name not in inc:
                continue
        elif spec.name in exc:
            continue
        out.append(spec)
    return sorted(out, key=lambda s: (CATEGORIES.index(s.category), s.name))


def _load_all() -> None:
    import importlib
    for mod in ("schema", "replication", "config", "extensions", "sql_patterns", "functions", "sequences"):
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:  # category not written yet
            if e.name != f"{__package__}.{mod}":
                raise


def get(name: str) -> CheckSpec:
    _load_all()
    return REGISTRY[name]


def facts(name: str, catalog) -> DataFrame:
    return get(name).fn(catalog)
