"""Functions that run in Python workers, for executors that cannot import this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Let the module's functions and classes travel by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
