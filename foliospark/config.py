"""Settings: defaults, a publisher's own, and how they are laid over each other."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: The defaults that a configuration folder may override.
DEFAULTS: dict[str, Any] = {
    "normalization": {"collapse_internal_whitespace": True, "dehyphenate_line_endings": "safe"},
    "pdf": {"list_markers": ["•", "-", "—", "–"]},
    "classifier": {"enabled": False, "threshold": 0.85, "abstain_label": "abstain"},
    "docbook": {"root": "book", "dtd_system": "book.dtd"},
}


def merge(base: dict, over: dict) -> dict:
    """`over` laid over `base`, mapping by mapping; anything else, lists too, is replaced. Neither changes."""
    return {k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def load(folder: str | Path | None = None, publisher: str | None = None) -> dict:
    """The defaults, then `folder`/mapping.default.json, then the publisher's file; files that are missing are passed over."""
    settings = DEFAULTS
    if folder is not None:
        for path in (Path(folder, "mapping.default.json"), Path(folder, "publishers", f"{publisher}.json")):
            if path.is_file():
                settings = merge(settings, json.loads(path.read_text(encoding="utf-8")))
    return settings


@dataclass(frozen=True)
class Normalization:
    """What becomes literals of the plan."""

    collapse: bool = True
    dehyphenate: bool = True

    @classmethod
    def of(cls, settings: dict) -> Normalization:
        own = settings.get("normalization", {})
        return cls(bool(own.get("collapse_internal_whitespace")), own.get("dehyphenate_line_endings") in ("safe", True))
