"""Where a rotated detector meets a model, on arrays: what a task needs to make views and to merge them.

A geometry has `columns` (of the table of rotations that it reads), `dims` (of the model) and at(rot, q, size): the
coordinates (rotations, pixels, dims) of detector pixels q (pixels, 3) in a model of `size` cells along each axis. Any
object with these may stand for one of those below.
"""

from __future__ import annotations

import itertools
from typing import Protocol

import numpy as np

from speckle.operators.views import TINY


class Geometry(Protocol):
    columns: tuple[str, ...]
    dims: int

    def at(self, rot: np.ndarray, q: np.ndarray, size: int) -> np.ndarray: ...


class Plane:
    """Detectors turned by an angle in the plane of a stack of 2D models."""

    columns, dims = ("angle",), 2

    def at(self, rot: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        c, s = np.cos(rot[:, :1]), np.sin(rot[:, :1])
        return np.stack([c * q[:, 0] - s * q[:, 1], s * q[:, 0] + c * q[:, 1]], 2) + size // 2


class Axial:
    """An in-plane angle phi, then a tilt beta; models hold (distance from the axis, height)."""

    columns, dims = ("phi", "beta"), 2

    def at(self, rot: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        c, s, cb, sb = np.cos(rot[:, :1]), np.sin(rot[:, :1]), np.cos(rot[:, 1:2]), np.sin(rot[:, 1:2])
        u, v = c * q[:, 0] - s * q[:, 1], s * q[:, 0] + c * q[:, 1]
        return np.stack([np.hypot(u, sb * v + cb * q[:, 2]), cb * v - sb * q[:, 2] + size // 2], 2)


class Volume:
    """Unit quaternions and a volume."""

    columns, dims = ("q0", "q1", "q2", "q3"), 3

    def at(self, rot: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        a, b, c, d = rot.T
        m = np.array([
            [1 - 2 * (c * c + d * d), 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), 1 - 2 * (b * b + d * d), 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), 1 - 2 * (b * b + c * c)],
        ])
        return np.einsum("ijn,pj->npi", m, q) + size // 2


def cells(coords: np.ndarray, size: int):
    """(inside, then place and weight of each corner) of coordinates (..., dims), cut towards zero as views.corners() does."""
    low = coords.astype(np.int64)
    inside = ((coords >= 0) & (low <= size - 2)).all(-1)
    low = np.where(inside[..., None], low, 0)
    part = coords - low
    dims = coords.shape[-1]
    out = []
    for bits in itertools.product((0, 1), repeat=dims):
        place, weight = 0, 1.0
        for i, b in enumerate(bits):
            place, weight = place * size + low[..., i] + b, weight * (part[..., i] if b else 1 - part[..., i])
        out.append((place, weight))
    return inside, out


def look_up(model: np.ndarray, coords: np.ndarray, corr: np.ndarray, size: int) -> np.ndarray:
    """The model at the coordinates, times corr; TINY outside and where that is not positive."""
    inside, corners = cells(coords, size)
    value = sum(model[place] * weight for place, weight in corners) * corr
    return np.where(inside & (value > 0), value, TINY)


def put_back(total: np.ndarray, weights: np.ndarray, coords: np.ndarray, values: np.ndarray, size: int, times: int = 1) -> None:
    """Adds values, dealt to the corners of their cells, to total, and what corners take to weights, both as often as `times`."""
    inside, corners = cells(coords, size)
    for place, weight in corners:
        at, w = place[inside], times * weight[inside]
        np.add.at(total, at, w * values[inside])
        np.add.at(weights, at, w)
