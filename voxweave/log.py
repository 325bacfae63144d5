"""What the package's loggers write on the driver: one line a record, to standard output unless another stream is given."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

#: The levels that may be asked for.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


class Line(logging.Formatter):
    """Level, seconds since the process began logging, the logger's name within the package, and the message."""

    def format(self, record: logging.LogRecord) -> str:
        where = record.name.removeprefix("voxweave.")
        text = f"[{record.levelname.lower()} {record.relativeCreated / 1000:.1f}s] {where}: {record.getMessage()}"
        return f"{text}\n{self.formatException(record.exc_info)}" if record.exc_info else text


def configure(level: str = "INFO", stream: TextIO | None = None) -> logging.Logger:
    """The package's logger, writing records from a level on; the loggers of others are left as they are."""
    levels = logging.getLevelNamesMapping()
    out = logging.StreamHandler(stream or sys.stdout)
    out.setFormatter(Line())
    ours = logging.getLogger("voxweave")
    ours.handlers, ours.propagate = [out], False
    ours.setLevel(levels.get(level.upper(), logging.INFO))
    return ours
