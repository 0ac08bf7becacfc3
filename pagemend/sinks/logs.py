"""The log of a run, on the console and in a file."""

from __future__ import annotations

import logging
import sys
from pathlib import Path


class RunLog:
    """``with RunLog(path) as log: log("text")``; safe from several threads, the file is closed at the end."""

    def __init__(self, path: Path):
        self.path = path
        self._logger = logging.Logger(f"pagemend.{path.name}", logging.INFO)

    def __enter__(self):
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(self.path, mode="w", encoding="utf-8")):
            handler.setFormatter(logging.Formatter("%(message)s"))
            self._logger.addHandler(handler)
        return self

    def __call__(self, message: str) -> None:
        self._logger.info("%s", message)

    def __exit__(self, *error) -> None:
        for handler in list(self._logger.handlers):
            self._logger.removeHandler(handler)
            if isinstance(handler, logging.FileHandler):
                handler.close()
