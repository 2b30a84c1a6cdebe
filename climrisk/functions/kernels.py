"""Small numeric helpers: filter weights for a plan, and the tail of the paired test."""

from __future__ import annotations

import math

import numpy as np

def smoothing_matrix(window: int, order: int) -> np.ndarray:
    """Row i gives the weights of the least-squares polynomial at sample i of `window`."""
    v = np.vander(np.arange(window) - (window - 1) / 2, order + 1)
    q, _ = np.linalg.qr(v)
    return q @ q.T


def chi2_one_df_tail(statistic: float) -> float:
    return math.erfc(math.sqrt(statistic / 2))
