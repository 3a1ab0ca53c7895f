"""Calls, text, JSON and frames to a log, if it is on. Logging a frame never runs it, unless rows are asked for."""

from __future__ import annotations

import functools
import json
import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

LOG = logging.getLogger("tablewright")
SWITCH = "ETL_LOGGING"
MOST = 500
BUCKET_S = 600


def enabled() -> bool:
    return os.environ.get(SWITCH, "").lower() in ("1", "true", "yes", "on")


def bucket(now: float | None = None) -> str:
    """File name for a stretch of ten minutes."""
    at = time.time() if now is None else now
    return time.strftime("log_%Y%m%d_%H%M.txt", time.gmtime(at - at % BUCKET_S))


def attach(folder: str) -> logging.Handler:
    """Log to files in ``folder``, one for each ten minutes."""
    os.makedirs(folder, exist_ok=True)

    class Buckets(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            with open(os.path.join(folder, bucket(record.created)), "a") as f:
                f.write(self.format(record) + "\n")

    handler = Buckets()
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    return handler


def short(x) -> str:
    """A short text; a frame is its schema."""
    text = x.schema.simpleString() if isinstance(x, DataFrame) else repr(x)
    return text if len(text) <= MOST else f"{text[:MOST]}..."


def log_string(label: str, value) -> None:
    if enabled():
        LOG.info("%s: %s", label, short(value))


def log_json(label: str, value) -> None:
    if enabled():
        LOG.info("%s: %s", label, json.dumps(value, default=str))


def log_frame(label: str, df: DataFrame, rows: int = 0) -> None:
    if enabled():
        LOG.info("%s: %s", label, [r.asDict() for r in df.limit(rows).collect()] if rows else short(df))


def log_call(fn: Callable) -> Callable:
    @functools.wraps(fn)
    def run(*args, **kwargs):
        if not enabled():
            return fn(*args, **kwargs)
        began = time.time()
        try:
            out = fn(*args, **kwargs)
        except Exception as e:
            LOG.info("%s(%s) raised %r after %.3f s", fn.__name__, ", ".join(map(short, args)), e, time.time() - began)
            raise
        LOG.info("%s(%s) -> %s in %.3f s", fn.__name__, ", ".join(map(short, args)), short(out), time.time() - began)
        return out

    return run
