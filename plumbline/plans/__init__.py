"""The queries, by family."""

from . import capture, detect, history, labels, masters, vision  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
