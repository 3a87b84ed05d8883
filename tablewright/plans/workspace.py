"""What surrounds a run: its files, its optional features, its logs and the time its stages take. Driver only."""

from __future__ import annotations

import logging
import logging.config
import os
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from tablewright.errors import ConfigError, FeatureUnavailable
from tablewright.plans.settings import Settings
from tablewright.sources.guards import redact

#: The file that marks a home folder, and the variables that name one and a database.
MARK, HOME, DATABASE = "tablewright.yaml", "TABLEWRIGHT_HOME", "DATABASE_URL"
#: Variables without which a feature cannot work.
NEEDS: dict[str, tuple[str, ...]] = {"email": ("SMTP_HOST", "SMTP_FROM"), "ai_analysis": ("AI_API_KEY",), "google_sheets": ("GOOGLE_SERVICE_ACCOUNT_FILE",)}


@dataclass(frozen=True)
class Workspace:
    settings: Settings = Settings()
    environment: Mapping[str, str] = field(default_factory=lambda: os.environ)
    start: Path = field(default_factory=Path.cwd)

    @property
    def home(self) -> Path:
        """The folder that the environment names, else the nearest one above the start that holds MARK, else the start."""
        if named := self.environment.get(HOME):
            return Path(named).expanduser().resolve()
        start = self.start.resolve()
        return next((p for p in (start, *start.parents) if (p / MARK).is_file()), start)

    def locate(self, path: str | Path) -> Path:
        """A path below the home folder, unless it is absolute."""
        return (self.home / Path(path).expanduser()).resolve()

    def path(self, name: str) -> Path:
        """A path by its name in the settings."""
        if name not in self.settings.paths:
            raise ConfigError(f"no path is called {name!r}; there are {', '.join(sorted(self.settings.paths))}")
        return self.locate(self.settings.paths[name])

    def folder(self, name: str) -> Path:
        """path(), made if it is not there."""
        self.path(name).mkdir(parents=True, exist_ok=True)
        return self.path(name)

    @property
    def holidays(self) -> Path | None:
        return self.locate(self.settings.holidays) if self.settings.holidays else None

    @property
    def database(self) -> str:
        """The URL in the environment, else a local file."""
        return self.environment.get(DATABASE) or f"sqlite:///{self.path('database').as_posix()}"

    def features(self) -> dict[str, bool]:
        """Each feature, and whether it is switched on and has all it needs."""
        return {name: on and all(self.environment.get(n) for n in NEEDS.get(name, ())) for name, on in self.settings.features.items()}

    def need(self, feature: str) -> None:
        if self.features().get(feature):
            return
        lacking = [n for n in NEEDS.get(feature, ()) if not self.environment.get(n)]
        why = f"it needs {', '.join(lacking)}" if self.settings.features.get(feature) else "it is switched off"
        raise FeatureUnavailable(f"{feature} is not available: {why}")


class Redacting(logging.Filter):
    """Takes passwords out of messages, arguments included."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact(record.getMessage()), ()
        return True


def start_logging(folder: Path | None = None, *, level: str = "INFO", console: bool = True, size: int = 5 << 20, files: int = 3) -> logging.Logger:
    """The package's logger, with the handlers asked for and no others: a second call replaces those of the first."""
    handlers: dict[str, dict] = {}
    if console:
        handlers["console"] = {"class": "logging.StreamHandler"}
    if folder is not None:
        folder.mkdir(parents=True, exist_ok=True)
        handlers["file"] = {"class": "logging.handlers.RotatingFileHandler", "filename": str(folder / "tablewright.log"), "maxBytes": size, "backupCount": files, "encoding": "utf-8"}
    shared = {"formatter": "line", "filters": ["redacting"]}
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"line": {"format": "%(asctime)s %(levelname)s %(name)s: %(message)s"}},
            "filters": {"redacting": {"()": Redacting}},
            "handlers": {name: handler | shared for name, handler in handlers.items()},
            "loggers": {"tablewright": {"level": level, "handlers": list(handlers), "propagate": False}},
        }
    )
    return logging.getLogger("tablewright")


class Stage:
    """Seconds since the start, until it ends."""

    def __init__(self, label: str) -> None:
        self.label, self._began, self._ended = label, time.perf_counter(), None

    @property
    def seconds(self) -> float:
        return round((self._ended or time.perf_counter()) - self._began, 3)

    def end(self) -> None:
        self._ended = time.perf_counter()


@contextmanager
def stage(label: str) -> Iterator[Stage]:
    """Times a block on the driver, also one that fails, and logs it."""
    own = Stage(label)
    try:
        yield own
    finally:
        own.end()
        logging.getLogger("tablewright.stages").info("%s took %.3f s", label, own.seconds)
