"""Settings: a file of "key: value" lines, where it lies, and filters on nested settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

SIZES, DEVICES = ("tiny", "base", "large"), ("auto", "cpu", "cuda", "mps")


@dataclass(frozen=True)
class Config:
    model_size: str
    device: str
    num_workers: int
    torch_compile: bool
    typo_batch_size: int
    char_batch_size: int
    seq2seq_batch_size: int
    word_batch_size: int

    def __post_init__(self) -> None:
        if self.model_size not in SIZES or self.device not in DEVICES:
            raise ValueError(f"model_size is one of {SIZES}, device of {DEVICES}")


def config_path(env: Mapping[str, str] = os.environ, name: str = "tsumugi") -> Path:
    """The settings' place: {NAME}_CONFIG_FILE, else below XDG_CONFIG_HOME, else below ~/.config."""
    own = env.get(f"{name.upper()}_CONFIG_FILE")
    base = Path(env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "~")).expanduser() / ".config")
    return Path(own) if own else base / name / "config.yaml"


def read_config(text: str, **overrides: object) -> Config:
    """Settings of flat "key: value" lines, with overrides that aren't None. A key that is missing or unknown is an error."""
    raw: dict[str, object] = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a setting: {line!r}")
            raw[key.strip()] = value.strip().strip("'\"")
    raw |= {k: v for k, v in overrides.items() if v is not None}
    kinds = {f.name: f.type for f in fields(Config)}
    if set(raw) != set(kinds):
        raise ValueError(f"settings missing: {sorted(set(kinds) - set(raw))}, unknown: {sorted(set(raw) - set(kinds))}")

    def made(kind: str, value: object) -> object:
        if kind == "bool":
            if str(value).lower() not in ("true", "false"):
                raise ValueError(f"not true or false: {value!r}")
            return str(value).lower() == "true"
        return int(str(value)) if kind == "int" else str(value)

    return Config(**{k: made(str(kinds[k]), v) for k, v in raw.items()})


def without_keys(settings: object, dropped: frozenset[str] | set[str]) -> object:
    """Nested settings without the named keys, at any depth."""
    if isinstance(settings, dict):
        return {k: without_keys(v, dropped) for k, v in settings.items() if k not in dropped}
    return [without_keys(x, dropped) for x in settings] if isinstance(settings, list) else settings
