"""Results kept between sessions, with a sliding time to live."""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
import time
from datetime import UTC, datetime

from lineloom.options import BaseOptions


class ResultCache:
    """A key-value file of JSON results; reading an entry renews it."""

    def __init__(self, path: str, ttl_seconds: float) -> None:
        self.ttl = ttl_seconds
        self.db = sqlite3.connect(path)
        with self.db:
            self.db.execute("CREATE TABLE IF NOT EXISTS results (key TEXT PRIMARY KEY, value TEXT, used REAL)")
            self.db.execute("DELETE FROM results WHERE used <= ?", (time.time() - ttl_seconds,))

    def put(self, key: str, value: object) -> None:
        with self.db:
            self.db.execute("INSERT INTO results VALUES (?, ?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value, used = excluded.used", (key, json.dumps(value, default=str), time.time()))

    def get(self, key: str) -> object | None:
        now = time.time()
        row = self.db.execute("SELECT value FROM results WHERE key = ? AND used > ?", (key, now - self.ttl)).fetchone()
        if row is None:
            return None
        with self.db:
            self.db.execute("UPDATE results SET used = ? WHERE key = ?", (now, key))
        return json.loads(row[0])

    def close(self) -> None:
        self.db.close()


def cache_key(kind: str, options: BaseOptions, *commits: str, today: datetime | None = None) -> str:
    """A key of all that a result depends on; relative dates make it depend on the day too."""
    parts = [kind, *map(str, commits), *(f"{k}={v}" for k, v in sorted(vars(options).items()) if not k.startswith("cache"))]
    dates = [getattr(options, k, "") for k in ("since", "until", "when")]
    if any(d and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) for d in dates):
        parts.append((today or datetime.now(UTC)).date().isoformat())
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
