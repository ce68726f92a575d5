"""Edge-light analytics on Spark: backlog, zone colours, display frames, playback events."""

from rimlight.model import Layout, Tuning

__all__ = ["Layout", "Tuning"]
