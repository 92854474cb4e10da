"""Placement of sheets on one canvas from scored fits of pairs: a table of places and of each sheet's free sides, grown by the best fit first.

A direction on the canvas is a complex number: 1 to the right, 1j down; a quarter turn counter-clockwise multiplies it by -1j.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from ..dimensions import EDGE_DIRECTIONS
from ..functions.geometry import OVERLAP_PX

MOST_COVERED = 0.45  # of a box's width and of its height, by a box that stands already
TOWARDS = {edge: complex(*d) for edge, d in EDGE_DIRECTIONS.items()}
SIDE = {d: edge for edge, d in TOWARDS.items()}


def quarters(angle: float) -> int:
    return round(angle / 90) % 4


class Fit(NamedTuple):
    """A scored pair as one of its sheets sees it: ``fixed`` stands, ``moving`` is to be set beside it; fits sort by score, best first."""

    loss: float
    fixed: str
    moving: str
    pair: tuple[str, str]
    edge: str
    turn: float

    def pose(self, angle: float) -> tuple[float, complex]:
        """The moving sheet's rotation, and the side of the fixed one it comes to, where that one is turned by ``angle``.

        The edge is one of the pair's first sheet, so it points away from that one, whichever of the two stands.
        """
        first_stands = self.fixed == self.pair[0]
        own = (angle + self.turn if first_stands else angle - self.turn + 360) % 360
        towards = TOWARDS[self.edge] * (-1j) ** quarters(angle if first_stands else own)
        return own, towards if first_stands else -towards


class Canvas:
    """Places by sheet, in order, and the sides of each sheet that are taken."""

    def __init__(self, size: Callable[[str, float, str | None], tuple[int, int]], overlap: int):
        self.size, self.overlap = size, overlap
        self.places: dict[str, dict] = {}
        self.boxes = np.zeros((0, 4), np.int64)  # left, top, right, bottom

    def put(self, sheet: str, angle: float, x: int, y: int, contact: str | None, how: str) -> None:
        w, h = self.size(sheet, angle, contact)
        taken = [contact] if contact else []
        self.places[sheet] = {"map_num": sheet, "rot": float(angle), "x": x, "y": y, "w": w, "h": h, "edges": taken, "how": how, "place": len(self.places)}
        self.boxes = np.vstack([self.boxes, [x, y, x + w, y + h]])

    def beside(self, fixed: str, towards: complex, w: int, h: int) -> tuple[int, int]:
        """Where a box goes that is centred along a side of a standing one and overlaps it a little."""
        at = self.places[fixed]
        spot = []
        for low, length, own, step in ((at["x"], at["w"], w, round(towards.real)), (at["y"], at["h"], h, round(towards.imag))):
            spot.append(low + (length - own) // 2 if not step else low + length - self.overlap if step > 0 else low - own + self.overlap)
        return spot[0], spot[1]

    def covered(self, x: int, y: int, w: int, h: int) -> bool:
        low, high = np.maximum(self.boxes[:, :2], [x, y]), np.minimum(self.boxes[:, 2:], [x + w, y + h])
        return bool(((high - low) > MOST_COVERED * np.array([w, h])).all(axis=1).any())

    def take(self, fit: Fit, how: str, certain: bool = False) -> bool:
        """Set the moving sheet of a fit, unless its side is taken or its box covers another (of which ``certain`` asks neither)."""
        angle, towards = fit.pose(self.places[fit.fixed]["rot"])
        taken, contact = self.places[fit.fixed]["edges"], SIDE[-towards]
        w, h = self.size(fit.moving, angle, contact)
        x, y = self.beside(fit.fixed, towards, w, h)
        if not certain and (SIDE[towards] in taken or self.covered(x, y, w, h)):
            return False
        self.put(fit.moving, angle, x, y, contact, how)
        if SIDE[towards] not in taken:
            taken.append(SIDE[towards])
        return True


def layout(scores: list[dict], sizes: dict[str, tuple[int, int]], seed: tuple[str, str] | None, overlap: int = OVERLAP_PX, pad: int = 200, size_of=None) -> list[dict]:
    """Places of sheets: map_num, rot, x, y, w, h, sides with a neighbour, how placed, and in which order.

    ``scores``: map_a, map_b, edge_a, edge_b, total_rot, combined_score; ``sizes``: (w, h) of every sheet; ``size_of(map, rot, contact)``
    overrides the size after a turn, which swaps sides at odd quarters. ``seed`` is the pair that stands first; None, or a pair that has no
    score, takes the best one. Then, again and again, of the fits between a standing and a waiting sheet that were not refused yet
    the best one is tried. Sheets that wait still try all their fits once more, until a round places none; the rest go in a row below.

    The fits of one panorama are some tens of rows, the sheets' pairs; this is a step of the driver's.
    """
    fits = []
    for s in scores:
        pair = (s["map_a"], s["map_b"])
        fits += [Fit(-s["combined_score"], *way, pair, s["edge_a"], s["total_rot"]) for way in (pair, pair[::-1])]
    if not fits:
        return []
    fits.sort()

    def turned(sheet, angle, contact):
        return size_of(sheet, angle, contact) if size_of else sizes[sheet][:: -1 if quarters(angle) % 2 else 1]

    canvas = Canvas(turned, overlap)
    first = next((f for f in fits if f.pair == seed), None) or fits[0]
    first = next(f for f in fits if f.pair == first.pair and f.fixed == f.pair[0])
    canvas.put(first.fixed, 0.0, 0, 0, first.edge, "seed")
    canvas.take(first, "seed", certain=True)

    refused: set[Fit] = set()
    while best := next((f for f in fits if f not in refused and f.fixed in canvas.places and f.moving not in canvas.places), None):
        if not canvas.take(best, "best"):
            refused.add(best)
    waiting, before = sorted(sizes.keys() - canvas.places.keys()), None
    while waiting and waiting != before:
        for sheet in waiting:
            any(canvas.take(f, "retry") for f in fits if f.moving == sheet and f.fixed in canvas.places)
        before, waiting = waiting, [s for s in waiting if s not in canvas.places]
    x, y = int(canvas.boxes[:, 0].min()), int(canvas.boxes[:, 3].max()) + pad
    for sheet in waiting:
        canvas.put(sheet, 0.0, x, y, None, "row")
        x += canvas.places[sheet]["w"] + pad // 2
    return list(canvas.places.values())
