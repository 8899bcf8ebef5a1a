"""Sensor geometry and window length: every operator takes one of these, nothing is global."""
from dataclasses import dataclass


@dataclass(frozen=True)
class Sensor:
    width: int
    height: int
    t0: int = 33_333          # window length in microseconds
    block: int = 20           # block side in pixels

    def nbx(self, side=None) -> int:
        return -(-self.width // (side or self.block))

    def nby(self, side=None) -> int:
        return -(-self.height // (side or self.block))


# the sensor of the adapter tables (sources/tables.py): one window is one day
DAY = 86_400_000_000
DEMO = Sensor(width=16, height=8, t0=DAY, block=4)
