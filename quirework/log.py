"""A logger for the console and, if wanted, a UTF-8 file."""

from __future__ import annotations

import logging


def logger(file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The package's logger; each handler is added once."""
    out = logging.getLogger("quirework")
    out.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    wanted: list[logging.Handler] = [] if any(type(h) is logging.StreamHandler for h in out.handlers) else [logging.StreamHandler()]
    if file is not None and not any(isinstance(h, logging.FileHandler) for h in out.handlers):
        wanted.append(logging.FileHandler(file, encoding="utf-8"))
    for h in wanted:
        h.setFormatter(form)
        out.addHandler(h)
    return out
