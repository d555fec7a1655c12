"""Named queries. Importing this package registers every query module."""

from __future__ import annotations

import importlib

from .core import REGISTRY, Query, register  # noqa: F401

_MODULES = ["logs_q", "windows_q", "text_q", "joins_q", "metrics_q", "traffic_q", "phys_q", "retr_q", "stream_q", "misc_q", "more_q", "extra_q", "interfaces_q", "files_q", "detail_q"]


def load_all() -> dict:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
