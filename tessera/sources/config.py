"""Settings from the environment, each parsed and held within its limits."""

from __future__ import annotations

import os
from dataclasses import dataclass


def read_bool(name: str, default: bool) -> bool:
    x = os.environ.get(name, "").strip().lower()
    return True if x in ("1", "true", "yes", "on") else False if x in ("0", "false", "no", "off") else default


def _number(kind, name: str, default, least, most):
    try:
        x = kind(os.environ[name].strip())
    except (KeyError, ValueError):
        x = default
    return min(max(x, least), most)


def read_int(name: str, default: int, least: int, most: int) -> int:
    return _number(int, name, default, least, most)


def read_float(name: str, default: float, least: float, most: float) -> float:
    return _number(float, name, default, least, most)


@dataclass(frozen=True)
class Settings:
    """What the engine acts on."""

    max_attempts: int = 3
    target_standard: str = "c++17"
    compile_timeout: int = 10
    run_timeout: int = 10
    max_tokens: int = 200_000
    output_limit: int = 10_000

    @classmethod
    def from_env(cls) -> Settings:
        return cls(read_int("MAX_ATTEMPTS", 3, 1, 10), os.environ.get("TARGET_STANDARD", "c++17"), read_int("COMPILE_TIMEOUT", 10, 1, 600), read_int("RUN_TIMEOUT", 10, 1, 600), read_int("CPP_PARSER_MAX_AST_NODES", 200_000, 1000, 1 << 31), read_int("OUTPUT_LIMIT", 10_000, 100, 1 << 31))
