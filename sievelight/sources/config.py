"""Settings of a scan in a TOML file."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass

# The makers of models that a setting may name.
PROVIDERS = ("openrouter", "groq", "openai", "anthropic", "xai", "nvidia_nim", "ollama")


@dataclass(frozen=True)
class ScanDefaults:
    deep: bool = False
    max_file_size_kb: int = 1000
    respect_gitignore: bool = True


@dataclass(frozen=True)
class Config:
    provider: str
    model: str
    base_url: str | None = None
    scan_defaults: ScanDefaults = ScanDefaults()


def load_config(path: str) -> Config | None:
    """The settings of a file; None if there is none, or one with a wrong name or kind of value."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        scan = data.get("scan_defaults", {})
        made = Config(data["provider"], data["model"], data.get("base_url"), ScanDefaults(**scan))
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None
    kinds = ((made.model, str), (made.base_url, str | None), *((getattr(made.scan_defaults, n), kind) for n, kind in (("deep", bool), ("max_file_size_kb", int), ("respect_gitignore", bool))))
    sound = made.provider in PROVIDERS and all(isinstance(v, kind) for v, kind in kinds) and not isinstance(made.scan_defaults.max_file_size_kb, bool)
    return made if sound else None


def save_config(config: Config, path: str) -> None:
    """Write the settings; a value that is not set is left out."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    # basic strings of TOML escape as those of JSON do
    lines = [f"{n} = {json.dumps(v)}" for n, v in (("provider", config.provider), ("model", config.model), ("base_url", config.base_url)) if v is not None]
    lines += ["", "[scan_defaults]"] + [f"{n} = {json.dumps(v)}" for n, v in vars(config.scan_defaults).items()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
