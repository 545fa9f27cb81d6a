"""Settings: files, whitelisted overrides, profiles and the evaluation policy. Small, so they live in the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

# The settings that a request may override, and their types.
OVERRIDES = {"retrieval_top_n": int, "retrieval_similarity_threshold": float, "query_fusion_enabled": bool, "query_fusion_num_queries": int, "query_fusion_mode": str, "generation_temperature": float, "generation_top_p": float, "max_output_tokens": int, "llm_seed": int}


@dataclass(frozen=True)
class Settings:
    retrieval_top_n: int = 6
    retrieval_similarity_threshold: float = 0.25
    query_fusion_enabled: bool = True
    query_fusion_num_queries: int = 4
    query_fusion_mode: str = "reciprocal_rank"
    generation_temperature: float = 0.0
    generation_top_p: float = 1.0
    max_output_tokens: int = 1024
    llm_seed: int | None = None


def to_bool(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    word = str(v).strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a boolean: {v!r}")


def overridden(base: Settings, given: dict[str, Any] | None) -> Settings:
    """base with the whitelisted settings of `given`, cast to their types; None changes nothing, and other names are left out."""
    cast = {k: (to_bool(v) if OVERRIDES[k] is bool else OVERRIDES[k](v)) for k, v in (given or {}).items() if k in OVERRIDES and v is not None}
    return replace(base, **cast)


def signature(given: dict[str, Any] | None) -> str:
    """A canonical name of a set of overrides."""
    return json.dumps({k: v for k, v in sorted((given or {}).items()) if k in OVERRIDES and v is not None}, sort_keys=True)


def read_config(path: str) -> dict[str, Any]:
    """A JSON object; an absent or empty file is an empty one, and anything else raises."""
    if not os.path.exists(path):
        return {}
    text = open(path, encoding="utf-8").read().strip()
    if not text:
        return {}
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def read_env(lines: list[str]) -> dict[str, str]:
    """KEY=VALUE lines; blank lines, comments and lines without = are left out."""
    out = {}
    for line in lines:
        line = line.strip().lstrip("﻿")
        if line and not line.startswith("#") and "=" in line:
            k, _, v = line.partition("=")
            out[k.strip()] = v.strip()
    return out


@dataclass(frozen=True)
class Policy:
    """Modes of an evaluation, each with its budget and split."""

    modes: dict[str, dict[str, Any]] = field(default_factory=dict)

    def mode(self, name: str) -> dict[str, Any]:
        if name not in self.modes:
            raise ValueError(f"unknown mode {name!r}; one of {', '.join(sorted(self.modes))}")
        return self.modes[name]

    def latency_budget(self, name: str) -> float:
        return float(self.mode(name).get("latency_budget_ms", 0))


def merged(defaults: dict[str, Any], baseline: dict[str, Any], env: dict[str, str], overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings by name: overrides before the environment before the baseline before the defaults.

    An empty value of the environment is none. A baseline value of 0, "" or nothing falls back to the default. Values of the environment
    get the default's type.
    """

    def read(name: str, default: Any) -> Any:
        raw = env.get(name.upper(), "").strip()
        if not raw:
            return baseline.get(name) or default
        if isinstance(default, bool):
            return raw.lower() in ("1", "true", "yes", "on")
        return type(default)(raw) if isinstance(default, (int, float)) else raw

    return {k: read(k, d) for k, d in defaults.items()} | {k: v for k, v in (overrides or {}).items() if v is not None}
