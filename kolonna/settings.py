"""Settings of a call: what its arguments say, else the session's overrides, else a YAML file, else the defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from types import MappingProxyType
from typing import Any

#: Values of this session, by name.
overrides: dict[str, Any] = {}


@dataclass(frozen=True)
class Settings:
    """``nest`` and ``dump`` of a query, the folder of the stored tables, the lines of history a console keeps; ``others`` are for the user's own functions."""

    nest: bool = False
    dump: bool = False
    warehouse: str | None = None
    history: int = 1000
    others: Mapping[str, Any] = field(default_factory=lambda: MappingProxyType({}))

    @classmethod
    def of(cls, settings_file: str | None = None, **arguments: Any) -> Settings:
        path = settings_file or overrides.get("settings_file") or os.environ.get("KOLONNA_SETTINGS")
        given = (read(path) if path and os.path.exists(path) else {}) | overrides | arguments
        known = {f.name for f in fields(cls)} - {"others"}
        rest = {k: v for k, v in given.items() if k not in known and k != "settings_file"}
        return cls(**{k: v for k, v in given.items() if k in known}, others=MappingProxyType(rest))


def read(path: str) -> dict[str, Any]:
    """The mapping of a settings file: YAML where its library is at hand, else its plain ``key: value`` lines."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        pairs = (line.split("#")[0].partition(":") for line in text.splitlines())
        plain = {"true": True, "false": False, "null": None, "": None}
        found = {k.strip(): v.strip().strip("'\"") for k, colon, v in pairs if colon}
        return {k: plain[v.lower()] if v.lower() in plain else int(v) if v.lstrip("-").isdigit() else v for k, v in found.items()}
    return yaml.safe_load(text) or {}
