"""Settings of the engine, with defaults. Unknown settings are errors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import time
from typing import Any

from tablewright.errors import ConfigError

#: Text that stands for a missing value.
PLACEHOLDERS = ("n/a", "na", "null", "none", "-", "--", "?", "tbd", "#n/a", "#value!", "#ref!", "nan")


def _one_of(name: str, value: str, choices: tuple[str, ...]) -> None:
    if value not in choices:
        raise ConfigError(f"{name} is {value!r}; one of {', '.join(choices)}")


@dataclass(frozen=True)
class Upload:
    allowed_extensions: tuple[str, ...] = (".csv", ".xlsx")
    max_file_size_mb: float = 200
    csv_encoding_fallbacks: tuple[str, ...] = ("utf-8", "utf-8-sig", "cp1252", "latin-1")

    def __post_init__(self) -> None:
        if self.max_file_size_mb <= 0:
            raise ConfigError("max_file_size_mb is not positive")
        object.__setattr__(self, "allowed_extensions", tuple("." + e.lower().lstrip(".") for e in self.allowed_extensions))


@dataclass(frozen=True)
class Validation:
    duplicate_check: bool = True
    missing_value_threshold: float = 5
    blocking_quality_score: float = 50
    sample_issue_rows: int = 20
    dayfirst: bool = True
    issue_log_limit: int = 5000


@dataclass(frozen=True)
class Cleaning:
    standardize_column_names: bool = True
    trim_whitespace: bool = True
    placeholder_values: tuple[str, ...] = PLACEHOLDERS
    remove_duplicate_rows: bool = True
    duplicate_keys: str = "quarantine"
    standardize_categories: bool = True
    category_case: str = "preserve"
    invalid_rows: str = "quarantine"
    change_log_limit: int = 5000
    #: How integer columns are typed: by the data (whole values only), or always bigint or double.
    integers: str = "data"

    def __post_init__(self) -> None:
        _one_of("duplicate_keys", self.duplicate_keys, ("quarantine", "keep"))
        _one_of("invalid_rows", self.invalid_rows, ("quarantine", "keep"))
        _one_of("category_case", self.category_case, ("preserve", "title", "upper", "lower"))
        _one_of("integers", self.integers, ("data", "bigint", "double"))
        object.__setattr__(self, "placeholder_values", tuple(v.strip().lower() for v in self.placeholder_values))


def clock(value: Any) -> time:
    """HH:MM, or minutes since midnight as YAML reads 08:30 without quotes."""
    if isinstance(value, time):
        return value
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 24 * 60:
        return time(value // 60, value % 60)
    try:
        return time.fromisoformat(str(value))
    except ValueError as e:
        raise ConfigError(f"{value!r} is not a time of day") from e


@dataclass(frozen=True)
class Calendar:
    """Working hours, working days (Monday first) and the targets in working hours."""

    start: time = time(8)
    end: time = time(17)
    days: tuple[bool, ...] = (True, True, True, True, True, True, False)
    sla: dict[str, float] = field(default_factory=lambda: {"critical": 2, "high": 4, "medium": 8, "low": 24})

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", clock(self.start))
        object.__setattr__(self, "end", clock(self.end))
        if self.start >= self.end or len(self.days) != 7 or not any(self.days):
            raise ConfigError("the calendar has no working time")
        if min(self.sla.values(), default=1) <= 0:
            raise ConfigError("targets are not positive")

    @property
    def day_seconds(self) -> int:
        a, b = self.start, self.end
        return (b.hour - a.hour) * 3600 + (b.minute - a.minute) * 60 + b.second - a.second


@dataclass(frozen=True)
class Anomaly:
    method: str = "iqr"
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    rolling_window: int = 7
    rolling_threshold_pct: float = 50
    pct_change_threshold: float = 100
    min_observations: int = 5

    def __post_init__(self) -> None:
        _one_of("method", self.method, ("iqr", "zscore", "rolling", "pct_change"))


@dataclass(frozen=True)
class Thresholds:
    """What counts as an exception."""

    negative_sales_allowed: bool = False
    max_discount_percent: float = 40
    zero_price_allowed: bool = False
    stockout_threshold: float = 0
    low_stock_days: float = 7
    overstock_days: float = 120
    slow_moving_days: int = 60
    minimum_margin_percent: float = 10
    negative_margin_allowed: bool = False
    high_value_threshold: float = 100_000
    pending_age_warning_hours: float = 24


@dataclass(frozen=True)
class Settings:
    upload: Upload = Upload()
    validation: Validation = Validation()
    cleaning: Cleaning = Cleaning()
    calendar: Calendar = Calendar()
    anomaly: Anomaly = Anomaly()
    thresholds: Thresholds = Thresholds()
    top_n: int = 10
    features: dict[str, bool] = field(default_factory=lambda: {"email": False, "ai_analysis": False, "google_sheets": False})
    paths: dict[str, str] = field(default_factory=lambda: {"logs": "logs", "reports": "reports", "uploads": "uploads", "database": "data/tablewright.db"})
    holidays: str | None = None


def settings(data: Mapping[str, Any]) -> Settings:
    """From nested mappings, as YAML gives them."""
    out = Settings()
    for name, value in data.items():
        if name not in {f.name for f in fields(Settings)}:
            raise ConfigError(f"unknown setting {name!r}")
        now = getattr(out, name)
        if isinstance(value, Mapping) and not isinstance(now, dict):
            if odd := set(value) - {f.name for f in fields(now)}:
                raise ConfigError(f"{name}: unknown setting(s) {', '.join(sorted(odd))}")
            value = replace(now, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        elif isinstance(now, dict) and isinstance(value, Mapping):
            value = now | dict(value)
        out = replace(out, **{name: value})
    return out
