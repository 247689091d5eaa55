"""Configuration: a flat file of known keys, strict; explicit arguments override it.

The file is ``key: value`` lines (a subset of YAML) or a JSON object; lists are
JSON lists or comma-separated. An unknown key or a value of the wrong kind is
an error.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

from ..functions.money import parse_usd
from .collect import Limits

DEFAULT_FILE = ".quillcount.yaml"


@dataclass(frozen=True)
class Config:
    models: tuple = ()
    profile: str = "none"
    estimate_bound: str = "expected"
    output_tokens: tuple = ()
    reasoning_tokens: int = 0
    cached_tokens: int = 0
    processing: str = "native"
    image_detail: str = "auto"
    document_detail: str = "auto"
    overrides: tuple = ()
    include_hidden: bool = False
    max_file_bytes: int = Limits.file
    max_total_bytes: int = Limits.total
    max_media_bytes: int = Limits.media
    max_media_count: int = Limits.media_count
    max_pages: int = Limits.pages
    max_duration: str = "4h"
    max_input_tokens: int = 0
    max_cost_usd: str = ""
    fail_on_overflow: bool = False
    fail_on_incomplete: bool = False
    verify: bool = False
    require_verify: bool = False
    allow_file_upload: bool = False
    catalog: str = ""
    history: str = ""
    save: bool = True

    def __post_init__(self):
        duration_ms(self.max_duration)
        if self.max_cost_usd:
            parse_usd(self.max_cost_usd)

    def limits(self) -> Limits:
        return Limits(self.max_file_bytes, self.max_total_bytes, self.max_media_bytes, self.max_media_count, self.max_pages, duration_ms(self.max_duration))


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as ``1h30m`` or ``2.5s``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"invalid duration {text!r}")
    return round(sum(float(n) * {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000}[u] for n, u in parts))


def parse_ints(text: str) -> tuple:
    """Comma-separated non-negative numbers, ascending, at least one."""
    found = sorted(int(x) for x in text.split(",") if x.strip())
    if not found or found[0] < 0:
        raise ValueError(f"invalid numbers {text!r}")
    return tuple(found)


def _value(key: str, raw, default):
    if isinstance(default, bool):
        if raw in (True, "true"):
            return True
        if raw in (False, "false"):
            return False
        raise ValueError(f"{key} must be true or false")
    if isinstance(default, int):
        return int(raw)
    if isinstance(default, tuple):
        items = raw if isinstance(raw, list) else json.loads(raw) if str(raw).startswith("[") else [x.strip() for x in str(raw).split(",") if x.strip()]
        return tuple(int(x) for x in items) if key == "output_tokens" else tuple(items)
    return str(raw)


def load_config(path: str | None = None, root: str = ".", **overrides) -> Config:
    """The file's settings with ``overrides`` on top; only a default file may be missing."""
    file = Path(path) if path else Path(root) / DEFAULT_FILE
    raw: dict = {}
    if path or file.exists():
        text = file.read_text()
        if text.lstrip().startswith("{"):
            raw = json.loads(text)
        else:
            for n, line in enumerate(text.splitlines(), 1):
                line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
                if not line:
                    continue
                key, colon, value = line.partition(":")
                if not colon or line[0] == " ":
                    raise ValueError(f"{file}:{n}: expected key: value")
                raw[key] = value.strip().strip("\"'")
    known = {f.name: f for f in fields(Config)}
    if unknown := set(raw) - set(known):
        raise ValueError(f"unknown keys {sorted(unknown)}")
    base = Config()
    base = replace(base, **{k: _value(k, v, getattr(base, k)) for k, v in raw.items()})
    return replace(base, **{k: v for k, v in overrides.items() if v is not None})


def default_history() -> str:
    home = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(home, "quillcount", "runs")
