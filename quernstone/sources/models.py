"""Model files for plug-ins: fetched once, checked against a pinned sum, put in place in one step."""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import urllib.request
from pathlib import Path

_lock = threading.Lock()
_checked: set[tuple[str, str]] = set()


def digest(path: Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def fetch(url: str, sha256: str, folder: str | Path) -> Path:
    """The file of a URL in a folder, with this sum; another sum is an error and leaves nothing behind.

    A file that is there already is taken if its sum is right, and fetched anew if not; each is
    summed once in a process. Processes that fetch the same file at once each put a whole one in place.
    """
    target = Path(folder) / url.rstrip("/").rsplit("/", 1)[-1]
    with _lock:
        if (str(target), sha256) in _checked and target.exists():
            return target
        if not target.exists() or digest(target) != sha256:
            target.parent.mkdir(parents=True, exist_ok=True)
            handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
            try:
                with os.fdopen(handle, "wb") as out, urllib.request.urlopen(url) as response:
                    while part := response.read(1 << 20):
                        out.write(part)
                found = digest(Path(name))
                if found != sha256:
                    raise ValueError(f"{url} has the sum {found}, not {sha256}")
                os.replace(name, target)
            finally:
                Path(name).unlink(missing_ok=True)
        _checked.add((str(target), sha256))
    return target
