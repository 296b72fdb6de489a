"""Activity log: JSON lines in two files, each half of the size cap, so that the newest are kept."""

from __future__ import annotations

import json
import os
import threading
import time
from typing import Any

LEVELS = {"error": 0, "info": 1, "debug": 2}


class ActivityLog:
    """Off unless it has a path.  A write that fails never fails a query."""

    def __init__(self, path: str | None = None, level: str = "info", cap_bytes: int = 50 << 20):
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        self.path, self.level, self.cap = path, level, cap_bytes
        self._lock = threading.Lock()

    @property
    def older(self) -> str:
        return f"{self.path}.1"

    def write(self, level: str, event: str, **fields: Any) -> None:
        if not self.path or LEVELS[level] > LEVELS[self.level]:
            return
        line = json.dumps({"ts": time.time(), "level": level, "event": event, **fields}, default=str) + "\n"
        with self._lock:
            try:
                if os.path.exists(self.path) and os.path.getsize(self.path) + len(line) > self.cap // 2:
                    os.replace(self.path, self.older)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(line)
            except OSError:
                pass

    def read(self) -> list[dict[str, Any]]:
        out = []
        for p in filter(None, (self.path and self.older, self.path)):
            if os.path.exists(p):
                with open(p, encoding="utf-8") as f:
                    out += [json.loads(x) for x in f]
        return out
