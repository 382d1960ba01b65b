"""Settings of the pipelines: a YAML file, merged with overrides, paths resolved beside it, checked."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a run needs; groups are plain dicts, as the file has them."""

    products: list[str] = field(default_factory=lambda: ["HG"])
    data: dict = field(default_factory=dict)
    data_quality: dict = field(default_factory=dict)
    roll_rules: dict = field(default_factory=dict)
    strip_analysis: dict = field(default_factory=dict)
    spread: dict = field(default_factory=dict)
    business_days: dict = field(default_factory=dict)
    output_dir: str = ""
    metadata_path: str = ""


DEFAULTS = {
    "data": {"timezone": "US/Central", "price_field": "close"},
    "strip_analysis": {"enabled": True, "dominance_ratio_threshold": 2.0, "expiry_window_business_days": 18, "filter_expiry_dominance": True},
    "spread": {"method": "zscore", "z_threshold": 1.5, "abs_min": None},
    "business_days": {"align_events": "none", "calendar_hierarchy": "override"},
}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, group by group."""
    both = lambda a, b: merged(a, b) if isinstance(a, dict) and isinstance(b, dict) else b
    return base | {k: both(base.get(k), v) for k, v in over.items()}


def settings(raw: dict, folder: str = ".") -> Settings:
    """Checked settings of a dict; relative paths start at folder, environment variables in them are filled in."""
    raw = merged(DEFAULTS, {k: v for k, v in raw.items() if v is not None})
    path = lambda p: str(Path(folder, os.path.expandvars(p)).resolve())
    if not isinstance(raw["data"]["timezone"], str):
        raise ValueError("data.timezone must be the name of a time zone")
    for group, key, known in (("spread", "method", ("zscore", "abs", "combined")), ("business_days", "align_events", ("none", "shift_next", "drop_closed"))):
        if str(raw[group].get(key)).lower() not in known:
            raise ValueError(f"{group}.{key} must be one of {', '.join(known)}")
    limits = raw["business_days"].get("volume_threshold") or {}
    if limits and limits.get("method", "dynamic") not in ("dynamic", "fixed"):
        raise ValueError("business_days.volume_threshold.method must be dynamic or fixed")
    if limits and limits.get("method", "dynamic") == "dynamic":
        tops = [int(r.get("max_days", -1)) for r in limits.get("dynamic_ranges") or []]
        if not tops or any(b <= a for a, b in zip([-1, *tops], tops)):
            raise ValueError("dynamic_ranges must be there and rise by max_days")
    days = {k: v for k, v in raw["business_days"].items() if k != "enabled"} | {"calendar_paths": [path(p) for p in raw["business_days"].get("calendar_paths", [])]}
    data = raw["data"] | ({"minute_root": path(raw["data"]["minute_root"])} if raw["data"].get("minute_root") else {})
    metadata = (raw.get("metadata") or {}).get("contracts") or raw.get("metadata_path") or "../metadata/contracts_metadata.csv"
    return Settings(raw.get("products") or ["HG"], data, raw.get("data_quality") or {}, raw.get("roll_rules") or {}, raw["strip_analysis"], raw["spread"], days, path(raw.get("output_dir") or "../outputs"), path(metadata))


def load(path: str, overrides: dict | None = None) -> Settings:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return settings(merged(yaml.safe_load(file) or {}, overrides or {}), str(Path(path).resolve().parent))
