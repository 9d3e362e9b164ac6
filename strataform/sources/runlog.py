"""The record of a run: its configuration, metrics as they come, and how it ended. Small local files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable


class RunLog:
    """with RunLog(folder, config) as log: log.metric(...). STATUS is running, done or failed."""

    def __init__(self, folder: str, config: dict) -> None:
        os.makedirs(folder, exist_ok=True)
        self.folder = folder
        self._write("config.json", json.dumps(config, indent=1, sort_keys=True))
        self._write("STATUS", "running")

    def _write(self, name: str, text: str) -> None:
        with open(f"{self.folder}/{name}.part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{self.folder}/{name}.part", f"{self.folder}/{name}")

    def metric(self, **values: float | str) -> None:
        with open(f"{self.folder}/metrics.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps({"t": round(time.time(), 3)} | values) + "\n")

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._write("STATUS", "done" if kind is None else f"failed: {kind.__name__}")


def sections(parts: dict[str, Callable[[], str]]) -> str:
    """A report of named parts; a part whose input is missing says so and doesn't stop the others."""
    out = []
    for name, make in parts.items():
        try:
            body = make()
        except (FileNotFoundError, KeyError) as e:
            body = f"missing: {type(e).__name__}"
        out.append(f"## {name}\n\n{body}\n")
    return "\n".join(out)
