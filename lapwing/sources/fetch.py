"""Polite fetching for ingestion jobs: retries with doubling waits, Retry-After, and a breaker that opens after repeated refusals."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

# Fixed values.
MAX_WAIT = 30.0
REFUSALS = 4


@dataclass
class Fetcher:
    """get(url) -> (status, headers, body). One per source and partition."""

    get: Callable[[str], tuple[int, dict, str]]
    retries: int = 3
    backoff: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    refused: int = field(default=0, init=False)

    @property
    def open(self) -> bool:
        return self.refused >= REFUSALS

    def fetch(self, url: str) -> str | None:
        wait = self.backoff
        for attempt in range(self.retries):
            if self.open:
                return None
            status, headers, body = self.get(url)
            if status == 429:
                self.refused += 1
                after = str(headers.get("Retry-After", ""))
                pause = float(after) if after.replace(".", "", 1).isdigit() else wait
            else:
                self.refused = 0
                if status < 400:
                    return body
                if status < 500:
                    return None
                pause = wait
            if attempt < self.retries - 1 and not self.open:
                self.sleep(min(pause, MAX_WAIT))
                wait = min(wait * 2, MAX_WAIT)
        return None
