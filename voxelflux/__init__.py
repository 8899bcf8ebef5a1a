"""Event-stream analytics as Spark DataFrame transformations."""
from .sensor import DEMO, Sensor

__all__ = ["DEMO", "Sensor"]
