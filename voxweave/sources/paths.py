"""Finding one file by a name that may be a little off."""

from __future__ import annotations

import os


def key(name: str) -> str:
    return "".join(c for c in name.casefold() if c.isalnum())


def resolve(path: str) -> str | None:
    """The file itself; the same path below the working folder; or the only file beside it whose name has the same letters and digits."""
    for p in (path, os.path.join(os.getcwd(), path.lstrip("/")) if os.path.isabs(path) else path):
        if os.path.isfile(p):
            return p
    folder = os.path.dirname(path) or "."
    if not os.path.isdir(folder):
        return None
    same = [n for n in sorted(os.listdir(folder)) if key(n) == key(os.path.basename(path)) and os.path.isfile(os.path.join(folder, n))]
    return os.path.join(folder, same[0]) if len(same) == 1 else None
