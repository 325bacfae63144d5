"""Stopping a job between two units of its work, by signal, by a line on standard input, or by a call."""

from __future__ import annotations

import signal
import sys
import threading
from collections.abc import Callable

#: Lines that ask for a halt.
WORDS = frozenset({"q", "quit", "stop", "pause"})


class Halted(Exception):
    """The job stopped on request; what it had finished is kept, and a later run goes on from there."""


class Halt:
    """As a context, listens for SIGINT and SIGTERM, and for WORDS if the input is a terminal.

    The first signal asks for a halt, which the job grants when its unit of work is done. The second one calls
    ``at_once`` (which a job sets to what stops its own work) and exits.
    """

    def __init__(self, listen: bool = False, at_once: Callable[[], None] = lambda: None):
        self.listen, self.at_once, self.reason = listen, at_once, ""
        self._asked = threading.Event()
        self._before: dict[int, object] = {}

    @property
    def asked(self) -> bool:
        return self._asked.is_set()

    def ask(self, reason: str = "asked") -> None:
        if not self.asked:
            self.reason = reason
            self._asked.set()

    def check(self, done: str) -> None:
        """Raises Halted if a halt was asked for."""
        if self.asked:
            raise Halted(f"paused after {done} ({self.reason}); the same call goes on from there")

    def on_signal(self, number: int, frame: object = None) -> None:
        if self.asked:
            self.at_once()
            raise SystemExit(1)
        self.ask(signal.Signals(number).name)

    def read_lines(self, lines) -> None:
        for line in lines:
            if line.strip().lower() in WORDS:
                self.ask("standard input")
                return

    def __enter__(self) -> Halt:
        if self.listen:
            self._before = {number: signal.signal(number, self.on_signal) for number in (signal.SIGINT, signal.SIGTERM)}
            if sys.stdin and sys.stdin.isatty():
                threading.Thread(target=self.read_lines, args=(sys.stdin,), daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        for number, handler in self._before.items():
            signal.signal(number, handler)
        self._before = {}
