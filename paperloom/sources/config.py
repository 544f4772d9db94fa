"""Settings: defaults, user file, project file, environment, then overrides."""

from __future__ import annotations

import copy
import os
import tomllib
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "general": {"data_dir": "~/.paperloom", "log_level": "INFO"},
    "crawler": {"parallelism": 8, "max_pages": 10_000, "max_depth": 10, "delay": 0.0, "respect_robots": True, "retry_attempts": 3, "cache_ttl_hours": 168},
    "chunker": {"target_chunk_size": 512, "max_chunk_size": 1024, "min_chunk_size": 64, "overlap_tokens": 64, "strategy": "auto"},
    "embeddings": {"provider": "hash", "model": "hash-8", "batch_size": 64},
    "storage": {"backend": "parquet", "metric": "cosine"},
}
_LEAST = {("crawler", "parallelism"): 1, ("crawler", "max_pages"): 1, ("crawler", "max_depth"): 0, ("chunker", "target_chunk_size"): 1, ("chunker", "max_chunk_size"): 1, ("chunker", "min_chunk_size"): 0, ("chunker", "overlap_tokens"): 0, ("embeddings", "batch_size"): 1}
_ONE_OF = {("storage", "metric"): ("cosine", "inner", "l2"), ("general", "log_level"): ("DEBUG", "INFO", "WARNING", "ERROR")}


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _toml(path: Path | None) -> dict:
    return tomllib.loads(path.read_text()) if path and path.is_file() else {}


def _project_file(start: Path) -> Path | None:
    return next((p / "paperloom.toml" for p in (start, *start.parents) if (p / "paperloom.toml").is_file()), None)


def _typed(value: Any, like: Any) -> Any:
    if isinstance(value, str) and isinstance(like, bool):
        return value.lower() in ("1", "true", "yes", "on")
    return type(like)(value) if isinstance(value, str) and not isinstance(like, str) else value


def load_config(*, overrides: dict | None = None, user_file: str | None = None, project_file: str | None = None, environ: dict[str, str] | None = None) -> dict[str, dict[str, Any]]:
    """Raises ValueError for an unknown section or key and for a value out of bounds."""
    return load_with_sources(overrides=overrides, user_file=user_file, project_file=project_file, environ=environ)[0]


def load_with_sources(*, overrides: dict | None = None, user_file: str | None = None, project_file: str | None = None, environ: dict[str, str] | None = None) -> tuple[dict[str, dict[str, Any]], dict[str, dict[str, str]]]:
    """(settings, where each comes from: default, user, project, environment or override)."""
    environ = os.environ if environ is None else environ
    env: dict[str, dict[str, str]] = {}
    for name, value in environ.items():
        if name.startswith("PAPERLOOM_") and "__" in name:
            section, key = name[len("PAPERLOOM_") :].lower().split("__", 1)
            env.setdefault(section, {})[key] = value
    files = [_toml(Path(user_file).expanduser() if user_file else Path.home() / ".config/paperloom/config.toml"), _toml(Path(project_file) if project_file else _project_file(Path.cwd()))]
    out: dict = copy.deepcopy(DEFAULTS)
    source = {section: dict.fromkeys(values, "default") for section, values in DEFAULTS.items()}
    for origin, layer in zip(("user", "project", "environment", "override"), (*files, env, overrides or {})):
        for section, values in layer.items():
            for key in values:
                if key not in DEFAULTS.get(section, {}):
                    raise ValueError(f"unknown setting {section}.{key}")
                source[section][key] = origin
            out = merged(out, {section: {k: _typed(v, DEFAULTS[section][k]) for k, v in values.items()}})
    for (section, key), least in _LEAST.items():
        if out[section][key] < least:
            raise ValueError(f"{section}.{key} must be at least {least}")
    for (section, key), allowed in _ONE_OF.items():
        if out[section][key] not in allowed:
            raise ValueError(f"{section}.{key} must be one of {', '.join(allowed)}")
    out["general"]["data_dir"] = str(Path(out["general"]["data_dir"]).expanduser())
    return out, source
