"""The live feed (S8) and the waits of its clients."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterable


class Hub:
    """Fan-out of messages to clients; a full queue drops what comes, no sender waits."""

    def __init__(self, queue: int = 1024, buffer: int = 256):
        self.queue, self.buffer, self.lock = queue, buffer, threading.Lock()
        self.pending: deque = deque()
        self.clients: dict[int, deque] = {}
        self.dropped = self.next = 0

    def subscribe(self) -> int:
        with self.lock:
            self.next += 1
            self.clients[self.next] = deque()
            return self.next

    def unsubscribe(self, client: int) -> None:
        with self.lock:
            self.clients.pop(client, None)

    def broadcast(self, kind: str, data) -> None:
        with self.lock:
            if not self.clients:
                return  # nobody listens
            if len(self.pending) >= self.queue:
                self.dropped += 1
            else:
                self.pending.append({"type": kind, "data": data})

    def dispatch(self) -> None:
        """Hands what is pending to the clients."""
        with self.lock:
            while self.pending:
                m = self.pending.popleft()
                for box in self.clients.values():
                    if len(box) >= self.buffer:
                        self.dropped += 1
                    else:
                        box.append(m)

    def take(self, client: int) -> list:
        with self.lock:
            box = self.clients.get(client, deque())
            out = list(box)
            box.clear()
            return out


def backoff(first: float = 1.0, most: float = 30.0) -> Iterable[float]:
    """Waits before each new try: doubled up to ``most``."""
    wait = first
    while True:
        yield wait
        wait = min(wait * 2, most)
