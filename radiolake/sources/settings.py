"""Typed settings: environment over file over default, with bounds."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Setting:
    name: str
    kind: type
    default: Any
    least: float | None = None
    most: float | None = None
    choices: tuple = ()

    @property
    def variable(self) -> str:
        return "RADIOLAKE_" + self.name.upper().replace(".", "_")

    def coerce(self, value: Any) -> Any:
        """The value in its type and bounds; an unusable one raises."""
        if self.kind is bool and isinstance(value, str):
            value = value.strip().lower() in ("1", "true", "yes", "on")
        out = self.kind(value)
        if self.choices and out not in self.choices:
            raise ValueError(f"{self.name}: {out!r} isn't one of {self.choices}")
        if self.least is not None and out < self.least or self.most is not None and out > self.most:
            raise ValueError(f"{self.name}: {out!r} isn't between {self.least} and {self.most}")
        return out


SETTINGS = [
    Setting("cluster.collapse_threshold", float, 0.9, 0.0, 1.0), Setting("cluster.max_per_class", int, 1500, 2), Setting("cluster.tick_seconds", int, 15, 0, 3600),
    Setting("capture.keep_packets", bool, False), Setting("capture.crc_tolerance_seconds", float, 2.0, 0.0, 60.0), Setting("monitor.rolling_seconds", float, 5.0, 0.1, 3600.0),
    Setting("watchdog.stall_seconds", float, 60.0, 1.0), Setting("watchdog.min_gap_seconds", float, 30.0, 0.0), Setting("watchdog.max_attempts", int, 3, 1),
    Setting("view.stable_min_packets", int, 500, 0), Setting("log.level", str, "info", choices=("error", "warning", "info", "verbose", "debug")),
]


def load(path: str | Path | None = None, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """All settings; a value that can't be used falls back to the next source, at last to the default."""
    environment = dict(os.environ) if environment is None else environment
    file = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    out = {}
    for s in SETTINGS:
        section, _, key = s.name.partition(".")
        for value in (environment.get(s.variable), file.get(section, {}).get(key)):
            if value is not None:
                try:
                    out[s.name] = s.coerce(value)
                    break
                except (TypeError, ValueError):
                    continue
        else:
            out[s.name] = s.default
    return out


def save(values: dict[str, Any], path: str | Path) -> None:
    """The settings that differ from their defaults, as TOML."""
    sections: dict[str, list[str]] = {}
    for s in SETTINGS:
        if s.name in values and (v := s.coerce(values[s.name])) != s.default:
            section, _, key = s.name.partition(".")
            sections.setdefault(section, []).append(f"{key} = {str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(34) + v + chr(34)}")
    Path(path).write_text("".join(f"[{n}]\n" + "\n".join(lines) + "\n\n" for n, lines in sections.items()))
