"""A small integer mixer that gives the same value in Spark SQL and in ANSI SQL engines.

Used wherever a deterministic pseudo-random choice is needed whose result should not depend on the
engine: keyed sampling, strand tie-breaks, the level/count split of reads. Inputs are reduced first, so
keys of any size stay inside 64-bit arithmetic.
"""

from __future__ import annotations

import numpy as np

MODULUS = 9_999_991
RANGE = 32_768


def mix(expr: str) -> str:
    """SQL text of a value in [0, RANGE) that looks random in `expr` (an integer expression)."""
    x = f"(({expr}) % {MODULUS})"
    return f"CAST(floor((({x}*({x}*40503 + 1103515245) + 12345) % 2147483648)/65536) AS BIGINT)"


def mix_values(x: np.ndarray) -> np.ndarray:
    """The same values for an array of integers that are not negative."""
    x = x % MODULUS
    return (x * (x * 40503 + 1103515245) + 12345) % 2147483648 // 65536


def floor_div(expr: str, by: int) -> str:
    return f"CAST(floor(({expr})/{by}) AS BIGINT)"
