"""The library's log: one rotating file, or whatever handlers the program has set."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

# Size of a log file, and older files that are kept.
MOST_BYTES, KEPT = 1_000_000, 2


def logger(folder: str | None = None) -> logging.Logger:
    """The logger "scriptorium"; with a folder it writes to app.log there, attached once."""
    log = logging.getLogger("scriptorium")
    if folder is not None:
        path = str(Path(folder, "app.log").resolve())
        if not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
            Path(folder).mkdir(parents=True, exist_ok=True)
            handler = RotatingFileHandler(path, maxBytes=MOST_BYTES, backupCount=KEPT, encoding="utf-8")
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(handler)
            log.setLevel(logging.INFO)
    return log
