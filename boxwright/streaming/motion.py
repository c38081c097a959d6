"""Constant-velocity motion of boxes (x, y, aspect or width, h): one independent position-velocity filter per term.

The noise is independent per term and a velocity moves only its own term, so an eight-term filter splits into four
filters of two terms. All four run side by side as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Noise relative to box size, and the noise of an aspect ratio, which has no size.
POSITION, VELOCITY = 1 / 20, 1 / 160
ASPECT_POSITION, ASPECT_VELOCITY, ASPECT_SEEN = 1e-2, 1e-5, 1e-1
START_POSITION, START_VELOCITY = 2, 10


@dataclass
class State:
    """Per term: position, velocity, and their variances and covariance."""

    at: np.ndarray
    speed: np.ndarray
    var: np.ndarray
    cross: np.ndarray
    speed_var: np.ndarray


def _scales(box: np.ndarray, aspect: bool) -> np.ndarray:
    """The box side that each term's noise is relative to."""
    return box[[3, 3, 3, 3]] if aspect else box[[2, 3, 2, 3]]


def _noise(box: np.ndarray, aspect: bool, share: float, fixed: float) -> np.ndarray:
    spread = share * _scales(box, aspect)
    return np.where([False, False, aspect, False], fixed, spread) ** 2


def begin(box: np.ndarray, aspect: bool) -> State:
    still = np.zeros(4)
    return State(
        box.astype(float), still, _noise(box, aspect, START_POSITION * POSITION, ASPECT_POSITION), still.copy(),
        _noise(box, aspect, START_VELOCITY * VELOCITY, ASPECT_VELOCITY),
    )


def advance(s: State, aspect: bool) -> State:
    """One frame ahead."""
    return State(
        s.at + s.speed, s.speed, s.var + 2 * s.cross + s.speed_var + _noise(s.at, aspect, POSITION, ASPECT_POSITION),
        s.cross + s.speed_var, s.speed_var + _noise(s.at, aspect, VELOCITY, ASPECT_VELOCITY),
    )


def surprise(s: State, box: np.ndarray, aspect: bool) -> float:
    """Squared distance of a seen box in units of its expected variance."""
    return float(((box - s.at) ** 2 / (s.var + _noise(s.at, aspect, POSITION, ASPECT_SEEN))).sum())


def blend(s: State, box: np.ndarray, aspect: bool) -> State:
    """The state after a box was seen."""
    total = s.var + _noise(s.at, aspect, POSITION, ASPECT_SEEN)
    off, trust, pull = box - s.at, s.var / total, s.cross / total
    return State(s.at + trust * off, s.speed + pull * off, s.var - trust * s.var, s.cross - trust * s.cross, s.speed_var - pull * s.cross)


def halted(s: State, *terms: int) -> State:
    """The state with some terms' velocities set to zero."""
    speed = s.speed.copy()
    speed[list(terms)] = 0.0
    return State(s.at, speed, s.var, s.cross, s.speed_var)
