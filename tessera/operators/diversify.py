"""Diversified selection among a bounded list of candidates, on the driver."""

from __future__ import annotations

from enum import Enum

import numpy as np


class Strategy(str, Enum):
    MMR = "mmr"  # Carbonell & Goldstein 1998
    MSD = "msd"  # Borodin, Lee & Ye 2012
    DPP = "dpp"  # Chen, Zhang & Zhou 2018
    COVER = "cover"  # Puthiya Parambath et al. 2016
    SSD = "ssd"  # Huang et al. 2021


def candidate_limit(total: int, selection_size: int, fraction: float = 0.1, least: int = 100, most: int = 1000) -> int:
    """A tenth of all rows, at least the selection and ``least``, at most ``most`` and all rows."""
    return min(max(int(total * fraction), selection_size, least), most, total)


def _dpp(unit: np.ndarray, scores: np.ndarray, k: int, d: float) -> tuple[list[int], list[float]]:
    """Greedy MAP of a determinantal process whose quality is exp(a * score)."""
    weight = (1 - d) / (2 * d)
    log_quality = weight * (scores - scores.max())
    residual = np.einsum("ij,ij->i", unit, unit)
    rows = np.zeros((0, len(scores)))
    picks: list[int] = []
    gains: list[float] = []
    for _ in range(k):
        gain = 2 * log_quality + np.log(np.maximum(residual, 1e-12))
        gain[picks] = -np.inf
        j = int(np.argmax(gain))
        picks.append(j)
        gains.append(float(gain[j]))
        e = (unit @ unit[j] - rows.T @ rows[:, j]) / np.sqrt(max(residual[j], 1e-12))
        rows = np.vstack([rows, e])
        residual = np.maximum(residual - e * e, 0)
    return picks, gains


def diversify(vectors: np.ndarray, scores: np.ndarray, k: int, strategy: Strategy | str = Strategy.MMR, diversity: float = 0.5, window: int = 10) -> tuple[list[int], list[float]]:
    """(picked rows in order, objective at each pick).  Ties go to the better ranked candidate."""
    strategy, d = Strategy(getattr(strategy, "value", strategy)), float(diversity)
    if not 0 <= d <= 1:
        raise ValueError("diversity must be between 0 and 1")
    scores, vectors = np.asarray(scores, dtype=float), np.asarray(vectors, dtype=float)
    n, k = len(scores), min(k, len(scores))
    if k <= 0:
        return [], []
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    if strategy is Strategy.DPP and d > 0:
        return _dpp(unit, scores, k, d)
    picks: list[int] = []
    gains: list[float] = []
    nearest, apart, covered = np.full(n, -np.inf), np.zeros(n), np.zeros(n)
    similar = np.maximum(unit @ unit.T, 0) if strategy is Strategy.COVER else None
    basis: list[np.ndarray] = []
    for step in range(k):
        if strategy is Strategy.COVER:
            gain = (1 - d) * scores + d * (np.sqrt(covered[None, :] + similar) - np.sqrt(covered)[None, :]).sum(axis=1)
        elif strategy is Strategy.SSD:
            rest = vectors.copy()
            for b in basis[-window:]:
                rest -= np.outer(rest @ b, b)
            gain = (1 - d) * scores + d * np.linalg.norm(rest, axis=1)
        elif step == 0 or strategy is Strategy.DPP:  # diversity 0 of a DPP: by score
            gain = scores.copy()
        elif strategy is Strategy.MMR:
            gain = (1 - d) * scores - d * nearest
        else:
            gain = (1 - d) * scores + d * apart
        gain[picks] = -np.inf
        j = int(np.argmax(gain))
        picks.append(j)
        gains.append(float(gain[j]))
        near = unit @ unit[j]
        nearest, apart = np.maximum(nearest, near), apart + 1 - near
        if similar is not None:
            covered += similar[j]
        if strategy is Strategy.SSD:
            left = vectors[j].copy()
            for b in basis[-window:]:
                left -= (left @ b) * b
            if (size := np.linalg.norm(left)) > 1e-12:
                basis.append(left / size)
    return picks, gains
