"""Settings: YAML with ${VAR} from the environment, dotted access, deep merge, checked keys; and .env files."""

from __future__ import annotations

import copy
import os
import re
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "paths": {"input": "data", "store": "store", "output": "out"},
    "forecast": {"horizon": 12, "long_term_horizon": 60, "season": 12, "folds": 5, "deny": [], "weights": {}},
    "features": {"profile": "basic", "shift": 1, "backward_fill": False},
    "quality": {"min_rows": 24, "max_null_ratio": 0.7},
}
_VAR = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def _filled(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _filled(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v) for v in value]
    return _VAR.sub(lambda m: os.environ.get(m[1], m[2] or ""), value) if isinstance(value, str) else value


def merged(a: dict, b: dict) -> dict:
    out = copy.deepcopy(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and comments are skipped, quotes dropped."""
    pairs = (line.strip().split("=", 1) for line in Path(path).read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


class Config:
    def __init__(self, given: dict | None = None):
        unknown = set(given or {}) - set(DEFAULTS)
        if unknown:
            raise KeyError(f"unknown sections: {sorted(unknown)}")
        self.data = merged(DEFAULTS, _filled(given or {}))

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        return cls(yaml.safe_load(Path(path).read_text()) or {})

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.data
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, dotted: str, value: Any) -> None:
        *parts, last = dotted.split(".")
        at = self.data
        for part in parts:
            at = at.setdefault(part, {})
        at[last] = value

    def save(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.data, sort_keys=False))
