"""Uniform streams for the risk simulation: their length is set by the settings, not by the data."""

from __future__ import annotations

import hashlib

import numpy as np

DIMENSIONS = 3  # yield, price and cost


def seeded_stream(seed: int, simulations: int) -> np.ndarray:
    """Uniforms of a PCG64 generator: yields first, then prices, then costs."""
    return np.random.default_rng(seed).random(DIMENSIONS * simulations)


def hashed_stream(seed: int, simulations: int) -> np.ndarray:
    """Uniforms from MD5("seed:index"), which any SQL engine can repeat."""
    digests = (hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(DIMENSIONS * simulations))
    return np.array([int(d[:13], 16) / 2.0**52 for d in digests])
