"""Session traces: one JSON object a line."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from quillon.guard import scrub


class Tracer:
    """Appends events to ``<dir>/<session>.jsonl``; SQL texts are scrubbed of personal data."""

    def __init__(self, directory: str, session: str | None = None):
        os.makedirs(directory, exist_ok=True)
        self.session = session or uuid.uuid4().hex
        self.path, self._lock = os.path.join(directory, f"{self.session}.jsonl"), threading.Lock()

    def emit(self, kind: str, **facts) -> None:
        if "sql" in facts:
            facts["sql"] = scrub(facts["sql"])
        line = json.dumps({"session": self.session, "at": time.time(), "event": kind, **facts}, default=str)
        with self._lock, open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")

    def events(self) -> list[dict]:
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(x) for x in f]
