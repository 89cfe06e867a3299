"""Neighbours on the globe inside a task: small helpers of the replays."""
from __future__ import annotations

import math
from collections.abc import Hashable, Iterator

from ..functions import geo


def metres(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    """Great-circle distance, as ``geo.distance_m``."""
    dy, dx = math.radians(lat2 - lat1) / 2, math.radians(lng2 - lng1) / 2
    h = math.sin(dy) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dx) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))


class Grid:
    """Keys at points, found by distance; cells are cubes through the globe, so poles and the date line are like other places.

    The keys of a ``within`` that holds FEW at most are looked through without cells.
    """

    FEW = 24

    def __init__(self, radius_m: float):
        self.radius = radius_m
        self.reach = math.degrees(radius_m / geo.EARTH_RADIUS_M) + 1e-9  # of latitude; rounding loses no neighbour
        self.few: dict[Hashable, dict[Hashable, tuple[float, float]] | None] = {}  # None: in cells
        self.cells: dict[tuple, dict[Hashable, tuple[float, float]]] = {}

    def _cube(self, lng: float, lat: float) -> tuple[int, int, int]:
        x, y = math.radians(lng), math.radians(lat)
        size = geo.EARTH_RADIUS_M / self.radius
        return (math.floor(size * math.cos(y) * math.cos(x)), math.floor(size * math.cos(y) * math.sin(x)), math.floor(size * math.sin(y)))

    def add(self, key: Hashable, lng: float, lat: float, within: Hashable = None) -> None:
        held = self.few.setdefault(within, {})
        if held is not None:
            held[key] = (lng, lat)
            if len(held) <= self.FEW:
                return
            self.few[within] = None
        for k, at in (held or {key: (lng, lat)}).items():
            self.cells.setdefault((within, *self._cube(*at)), {})[k] = at

    def remove(self, key: Hashable, lng: float, lat: float, within: Hashable = None) -> None:
        held = self.few[within]
        del (self.cells[(within, *self._cube(lng, lat))] if held is None else held)[key]

    def around(self, lng: float, lat: float, within: Hashable = None) -> Iterator[tuple[Hashable, tuple[float, float]]]:
        """Keys of one ``within`` that may lie in the radius, and their points."""
        held = self.few.get(within, {})
        if held is not None:
            yield from held.items()
            return
        x, y, z = self._cube(lng, lat)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                for k in (-1, 0, 1):
                    yield from self.cells.get((within, x + i, y + j, z + k), {}).items()

    def near(self, lng: float, lat: float, within: Hashable = None) -> list:
        return [key for key, (x, y) in self.around(lng, lat, within) if abs(y - lat) <= self.reach and metres(lng, lat, x, y) <= self.radius]
