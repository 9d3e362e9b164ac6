"""Small driver-side configuration: profiles merged deeply, values set from the command line, types kept."""

from __future__ import annotations

from typing import Any


def merged(base: dict, *profiles: dict) -> dict:
    """base with each profile laid over it, dictionaries merged key by key, anything else replaced."""
    out = dict(base)
    for profile in profiles:
        for k, v in profile.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerced(text: str, like: Any) -> Any:
    """text as the type of like; raises if it isn't one."""
    if isinstance(like, bool):
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{text!r} is no boolean")
        return text.lower() in ("true", "1", "yes")
    if isinstance(like, (list, tuple)):
        return [coerced(x.strip(), like[0] if like else "") for x in text.split(",") if x.strip()]
    return text if like is None or isinstance(like, str) else type(like)(text)


def with_settings(config: dict, settings: list[str]) -> dict:
    """config with a.b=value settings; a key that isn't there raises."""
    out = merged(config)
    for s in settings:
        path, _, text = s.partition("=")
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at[p] = dict(at[p])
            at = at[p]
        at[last] = coerced(text, at[last])
    return out
