"""Declarative contracts: columns, their rules, and rules between columns. Loaded from YAML or built in code."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tablewright.errors import ConfigError

NUMERIC, TEMPORAL = ("integer", "float", "percent"), ("date", "datetime")
TYPES = ("string", "category", *NUMERIC, *TEMPORAL)
DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "conformity")


@dataclass(frozen=True)
class Rule:
    """What a column must be."""

    type: str
    required: bool = False
    min: float | None = None
    max: float | None = None
    allowed: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    default: Any = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ConfigError(f"unknown column type {self.type!r}; one of {', '.join(TYPES)}")
        if self.default is not None and self.required:
            raise ConfigError("only optional columns have a default")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ConfigError("min is greater than max")

    @property
    def numeric(self) -> bool:
        return self.type in NUMERIC

    @property
    def temporal(self) -> bool:
        return self.type in TEMPORAL


@dataclass(frozen=True)
class Between:
    """A rule between two columns: not_before or not_after."""

    type: str
    column: str
    reference: str
    description: str = ""

    def __post_init__(self) -> None:
        if self.type not in ("not_before", "not_after"):
            raise ConfigError(f"unknown rule {self.type!r}")


@dataclass(frozen=True)
class Contract:
    """What a table must be."""

    description: str = ""
    business_key: tuple[str, ...] = ()
    allow_unexpected_columns: bool = True
    columns: dict[str, Rule] = field(default_factory=dict)
    consistency_rules: tuple[Between, ...] = ()

    def __post_init__(self) -> None:
        unknown = [k for k in self.business_key if k not in self.columns]
        for rule in self.consistency_rules:
            unknown += [c for c in (rule.column, rule.reference) if c not in self.columns]
        if unknown:
            raise ConfigError(f"unknown column(s) {', '.join(unknown)}")
        for rule in self.consistency_rules:
            kinds = [self.columns[c] for c in (rule.column, rule.reference)]
            if not (all(k.numeric for k in kinds) or all(k.temporal for k in kinds)):
                raise ConfigError(f"{rule.column} and {rule.reference} cannot be compared")

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(n for n, r in self.columns.items() if r.required)


def _build(kind: type, data: Mapping[str, Any], where: str) -> Any:
    if not isinstance(data, Mapping):
        raise ConfigError(f"{where} is not a mapping")
    known = {f.name for f in fields(kind)}
    if odd := [k for k in data if k not in known]:
        raise ConfigError(f"{where}: unknown setting(s) {', '.join(map(str, odd))}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
    except (TypeError, ConfigError) as e:
        raise ConfigError(f"{where}: {e}") from e


def contract(data: Mapping[str, Any], where: str = "contract") -> Contract:
    data = dict(data)
    columns = {n: _build(Rule, r, f"{where}.{n}") for n, r in (data.pop("columns", None) or {}).items()}
    rules = [_build(Between, r, f"{where}.consistency_rules") for r in data.pop("consistency_rules", ())]
    return _build(Contract, data | {"columns": columns, "consistency_rules": rules}, where)


def weights(data: Mapping[str, float]) -> dict[str, float]:
    """Five weights that sum to one."""
    if set(data) != set(DIMENSIONS) or abs(sum(data.values()) - 1) > 1e-6 or min(data.values()) < 0:
        raise ConfigError(f"weights of {', '.join(DIMENSIONS)} must sum to 1")
    return {d: float(data[d]) for d in DIMENSIONS}


@dataclass(frozen=True)
class Catalog:
    """Contracts by name, and the weights of the score."""

    contracts: dict[str, Contract]
    weights: dict[str, float]

    def __getitem__(self, name: str) -> Contract:
        if name not in self.contracts:
            raise ConfigError(f"no contract {name!r}; there are {', '.join(sorted(self.contracts))}")
        return self.contracts[name]


def load_yaml(path: str | Path) -> dict[str, Any]:
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"{path} does not exist") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is not valid YAML: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path} holds no settings")
    return data


def catalog(data: Mapping[str, Any]) -> Catalog:
    if odd := set(data) - {"datasets", "quality_score_weights"}:
        raise ConfigError(f"unknown section(s) {', '.join(sorted(odd))}")
    return Catalog({n: contract(d, n) for n, d in (data.get("datasets") or {}).items()}, weights(data.get("quality_score_weights") or {}))


def load_catalog(path: str | Path | None = None) -> Catalog:
    return catalog(load_yaml(path or Path(__file__).parent / "contracts.yaml"))


def check_code(code: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", code):
        raise ConfigError(f"{code!r} is not a code")
    return code
