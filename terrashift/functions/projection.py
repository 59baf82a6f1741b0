"""Forward ellipsoidal Albers equal-area projection as column arithmetic (Snyder 1987, Prof. Paper 1395, ch. 14)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    # WGS84 ellipsoid and the two standard parallels, origin latitude and central meridian.
    a: float = 6378137.0
    inv_f: float = 298.257223563
    lat0: float = 23.0
    lon0: float = -96.0
    sp1: float = 29.5
    sp2: float = 45.5

    @property
    def e2(self) -> float:
        f = 1.0 / self.inv_f
        return 2 * f - f * f

    def _q(self, phi: float) -> float:
        e, s = math.sqrt(self.e2), math.sin(phi)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _m(self, phi: float) -> float:
        s = math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - self.e2 * s * s)

    def constants(self) -> dict[str, float]:
        p1, p2, p0 = (math.radians(v) for v in (self.sp1, self.sp2, self.lat0))
        m1, m2, q1, q2 = self._m(p1), self._m(p2), self._q(p1), self._q(p2)
        n = (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return {"n": n, "c": c, "rho0": self.a * math.sqrt(c - n * self._q(p0)) / n, "e": math.sqrt(self.e2)}


def albers_forward(lon: Column, lat: Column, proj: Albers = Albers()) -> tuple[Column, Column]:
    """(x, y) in metres from degrees."""
    k = proj.constants()
    s = F.sin(F.radians(lat))
    q = (1 - proj.e2) * (
        s / (1 - proj.e2 * s * s) - F.log((1 - k["e"] * s) / (1 + k["e"] * s)) / (2 * k["e"])
    )
    rho = F.sqrt(k["c"] - k["n"] * q) * (proj.a / k["n"])
    theta = F.radians(lon - proj.lon0) * k["n"]
    return rho * F.sin(theta), F.lit(k["rho0"]) - rho * F.cos(theta)
