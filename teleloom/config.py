"""Settings: flags over environment over TOML file over defaults; unknown keys are refused."""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

ENV_PREFIX = "TELELOOM_"
#: Most points of a metric where none or too few are asked for.
DEFAULT_POINTS = 1000


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class ProxyAuth:
    type: str = ""
    token: str = ""
    username: str = ""
    password: str = ""
    headers: dict[str, str] = field(default_factory=dict)

    def has_fields(self) -> bool:
        return bool(self.token or self.username or self.password or self.headers)


@dataclass(frozen=True)
class Proxy:
    url: str = ""
    protocol: str = ""
    auth: ProxyAuth = field(default_factory=ProxyAuth)


@dataclass(frozen=True)
class Config:
    http: str = ":4319"
    otlp_grpc: str = "0.0.0.0:4317"
    otlp_http: str = "0.0.0.0:4318"
    proxy: Proxy = field(default_factory=Proxy)
    trace_cap: int = 1000
    metric_cap: int = 3000
    log_cap: int = 5000
    max_data_points: int = DEFAULT_POINTS
    log_level: str = "warn"
    debug: bool = False

    @property
    def points(self) -> int:
        """C4: not positive means the default."""
        return self.max_data_points if self.max_data_points > 0 else DEFAULT_POINTS

    def check(self) -> "Config":
        for name in ("trace_cap", "metric_cap", "log_cap"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be at least 1")
        return self


def _apply(cls, base, data: dict, where: str):
    known = {f.name: f for f in fields(cls)}
    unknown: list[str] = []
    out = {}
    for key, value in data.items():
        if key not in known:
            unknown.append(where + key)
            continue
        old = getattr(base, key)
        if isinstance(old, (Proxy, ProxyAuth)):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}{key} must be a table")
            value, more = _apply(type(old), old, value, f"{where}{key}.")
            unknown += more
        elif isinstance(old, bool) != isinstance(value, bool) or not isinstance(value, type(old)):
            raise ConfigError(f"{where}{key} must be {type(old).__name__}")
        out[key] = value
    return replace(base, **out), unknown


def load_file(path: str | Path) -> Config:
    """The file's settings over the defaults; a missing file gives the defaults."""
    try:
        data = tomllib.loads(Path(path).read_text())
    except FileNotFoundError:
        return Config()
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    cfg, unknown = _apply(Config, Config(), data, "")
    if unknown:
        raise ConfigError(f"{path}: unknown keys: {', '.join(sorted(unknown))}")
    return cfg


def resolve(path: str | Path | None = None, env: dict[str, str] | None = None, flags: dict | None = None) -> Config:
    """Flags, then environment (TELELOOM_TRACE_CAP and so on), then file, then defaults."""
    env = dict(os.environ) if env is None else env
    cfg = load_file(path) if path else Config()
    given: dict = {}
    for f in fields(Config):
        raw = env.get(ENV_PREFIX + f.name.upper())
        if raw is None or f.name == "proxy":
            continue
        old = getattr(cfg, f.name)
        try:
            given[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(raw)
        except ValueError as e:
            raise ConfigError(f"{ENV_PREFIX}{f.name.upper()}: {e}") from e
    given |= {k: v for k, v in (flags or {}).items() if v is not None}
    cfg, unknown = _apply(Config, cfg, given, "")
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cfg.check()


#: Level names.
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


def log_level(name: str) -> int:
    try:
        return LEVELS[name.strip().lower()]
    except KeyError:
        raise ConfigError(f"unknown log level {name!r}") from None


def make_logger(name: str, level: str, handlers: list[logging.Handler]) -> logging.Logger:
    """A logger that hands each record to all ``handlers``."""
    out = logging.getLogger(name)
    out.setLevel(log_level(level))
    out.handlers = list(handlers)
    out.propagate = False
    return out
