"""Registered queries and their SQL twins."""

from rimlight.checks import compaction, library, playback, streams, timeline, zones  # noqa: F401
from rimlight.checks.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
