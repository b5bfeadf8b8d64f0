"""Typed configuration: defaults, then a file, then per-run values; every problem is reported at once.

The keys are one table; the sections are built from it.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, make_dataclass, replace
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """All problems of a configuration, one a line."""


# Sections, keys and defaults of the configuration (backends: those of this engine).
KEYS: dict[str, dict[str, Any]] = {
    "llama": {"bin_dir": "", "host": "127.0.0.1", "port": 0, "server_start_timeout": 120, "ctx_size": 16384},
    "inference": {"mode": "sequential", "in_flight": 1},
    "ocr": {"backend": "stub", "model": "", "mmproj": "", "resolution": "gundam", "n_gpu_layers": "auto", "endpoint": ""},
    "vlm": {"backend": "stub", "model": "", "mmproj": "", "n_gpu_layers": "auto", "endpoint": ""},
    "figure": {"detect": "auto", "mode": "describe-only", "crop_padding": 0.02, "context_chars": 2000},
    "table": {"refine": True},
    "output": {"dir": ".", "name_from_bibtex": True, "full_suffix": True, "split": True, "page_numbers": False, "page_separators": False, "normalize_line_breaks": True, "clean": True, "clobber": True, "notice": True},
    "cache": {"enabled": True, "refresh": False},
    "workdir": {"path": "", "keep_intermediates": False},
    "bibtex": {"mode": "auto", "append_to_document": False},
    "net": {"offline": False},
}

# Long edge in pixels of each resolution, the values of each choice, and the ranges of numbers (least, most; None: open).
LONG_EDGE = {"tiny": 512, "small": 640, "base": 1024, "large": 1280, "gundam": 2048}
CHOICES = {
    ("figure", "detect"): ("auto", "grounding", "pdf-embedded", "none"), ("figure", "mode"): ("describe-only", "describe-and-keep", "placeholder"),
    ("inference", "mode"): ("sequential", "concurrent"), ("bibtex", "mode"): ("off", "on", "auto"), ("ocr", "resolution"): tuple(LONG_EDGE),
}
RANGES = {
    ("llama", "port"): (int, 0, 65535), ("llama", "ctx_size"): (int, 1, None), ("llama", "server_start_timeout"): (int, 1, None),
    ("inference", "in_flight"): (int, 1, None), ("figure", "crop_padding"): (float, 0, 1), ("figure", "context_chars"): (int, 0, None),
}


def _section(name: str) -> type:
    return make_dataclass(f"{name.capitalize()}Config", [(key, type(value), field(default=value)) for key, value in KEYS[name].items()], frozen=True, module=__name__)


SECTIONS = {name: _section(name) for name in KEYS}
globals().update({f"{name.capitalize()}Config": made for name, made in SECTIONS.items()})

_RunBase = make_dataclass("_RunBase", [(name, made, field(default_factory=made)) for name, made in SECTIONS.items()], frozen=True, module=__name__)


@dataclass(frozen=True)
class RunConfig(_RunBase):
    """The whole configuration; ``pages``, ``name`` and ``command`` are per-run only."""

    pages: str | None = None
    name: str | None = None
    command: str = "run"


def default_files() -> list[Path]:
    """Where a configuration is looked for if none is named: the working folder, then the user's."""
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    return [Path("config.toml"), home / "foliosmith" / "config.toml"]


def load_file(path: str | None) -> dict[str, Any]:
    """A TOML file; a named one must exist, else the first of ``default_files`` that there is."""
    if path is None:
        return next((load_file(str(p)) for p in default_files() if p.is_file()), {})
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e


def resolve(*layers: dict[str, Any]) -> RunConfig:
    """Merges layers, the last winning; None means unset, unknown keys are ignored; then validates."""
    config = RunConfig()
    for layer in layers:
        for name in KEYS:
            given = layer.get(name)
            if isinstance(given, dict):
                known = {k: v for k, v in given.items() if k in KEYS[name] and v is not None}
                config = replace(config, **{name: replace(getattr(config, name), **known)})
        config = replace(config, **{k: layer[k] for k in ("pages", "name", "command") if layer.get(k) is not None})
    if problems := validate(config):
        raise ConfigError("\n".join(problems))
    return config


def _number_problem(kind: type, value: Any, least: float, most: float | None) -> str | None:
    if isinstance(value, bool) or not isinstance(value, int if kind is int else (int, float)):
        return f"must be {'a whole number' if kind is int else 'a number'}, not {value!r}"
    if value < least or most is not None and value > most:
        return f"{value} is outside {least} to {'any' if most is None else most}"
    return None


def validate(config: RunConfig) -> list[str]:
    """Every problem of a configuration."""
    from .inference import known_backends

    out = []
    for name, keys in KEYS.items():
        own = getattr(config, name)
        for key, default in keys.items():
            value, at = getattr(own, key), f"{name}.{key}"
            problem = None
            if isinstance(default, bool):
                problem = None if isinstance(value, bool) else f"{value!r} is not true or false"
            elif (name, key) in CHOICES:
                problem = None if value in CHOICES[name, key] else f"{value!r} is none of {', '.join(CHOICES[name, key])}"
            elif (name, key) in RANGES:
                problem = _number_problem(RANGES[name, key][0], value, *RANGES[name, key][1:])
            elif key == "n_gpu_layers":
                problem = None if value in ("auto", "all") else "must be 'auto', 'all' or a whole number" if isinstance(value, str) else _number_problem(int, value, 0, None)
            elif key == "backend":
                problem = None if value in known_backends() else f"{value!r} is none of {', '.join(known_backends())}"
            elif not isinstance(value, str):
                problem = f"{value!r} is no text"
            if problem:
                out.append(f"{at}: {problem}")
    port = config.llama.port
    if config.command == "run" and config.inference.mode == "concurrent" and isinstance(port, int) and port != 0:
        out.append("llama.port: two servers at once can't share a fixed port; 0 picks free ones")
    return out


def as_dict(config: RunConfig) -> dict[str, Any]:
    """Sections and keys as plain values."""
    return {name: {f.name: getattr(getattr(config, name), f.name) for f in fields(getattr(config, name))} for name in KEYS}
