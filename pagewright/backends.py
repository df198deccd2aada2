"""Inference back ends: what turns pixels into probabilities, scores and logits.

No network weights are shipped. ``TemplateBackend`` is a deterministic stand-in
that reads pages set in the ruled glyphs of ``glyph``; its accuracy says nothing
about trained networks. ``ReplayBackend`` hands out tensors kept elsewhere.
"""

from __future__ import annotations

from functools import cache
from typing import Protocol

import numpy as np

from pagewright.errors import Refused
from pagewright.operators.pixels import DET_MEAN, DET_NORM, LINE_MEAN, LINE_NORM, PAD, borders

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'()-éèêàçüöäßñóíáú"
DICTIONARY = [*LETTERS, " "]
ROWS, COLUMNS, PITCH = 7, 5, 6


class InferenceBackend(Protocol):
    """All three get tensors less their mean, times their norm: a page, a line's patch at 160 x 80, a patch 48 high."""

    def load(self) -> None: ...
    def detect(self, image: np.ndarray) -> np.ndarray: ...
    def orient(self, patch: np.ndarray) -> np.ndarray: ...
    def recognise(self, patch: np.ndarray) -> np.ndarray: ...
    def close(self) -> None: ...


@cache
def glyph(letter: str) -> np.ndarray:
    """7 x 5 cells by a rule: a full stem on the left, then 28 cells from the code point's mixed bits."""
    x = ord(letter)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x * factor) & (2**64 - 1)
        x ^= x >> 29
    cells = np.array([x >> i & 1 for i in range(ROWS * (COLUMNS - 1))], bool).reshape(ROWS, COLUMNS - 1)
    cells[:, 0] |= np.arange(ROWS) % 2 == 0  # every letter hangs together
    return np.concatenate([np.ones((ROWS, 1), bool), cells], axis=1)


class TemplateBackend:
    def load(self) -> None:
        glyphs = np.stack([glyph(c) for c in LETTERS]).reshape(len(LETTERS), -1).astype(float)
        self._templates = glyphs * 2 - 1

    def detect(self, image: np.ndarray) -> np.ndarray:
        """Ink, spread sideways so that neighbouring letters touch, with what it encloses."""
        image = image / np.array(DET_NORM, np.float32) + np.array(DET_MEAN, np.float32)
        ink = image.min(axis=2) < 99.5
        reach = 3
        wide = ink.copy()
        for step in range(1, reach + 1):
            wide[:, step:] |= ink[:, :-step]
            wide[:, :-step] |= ink[:, step:]
        solid = wide.copy()
        for _, _, ys, xs in borders(wide):
            solid[ys, xs] = True
        return solid[None].astype(np.float32) * 0.9

    def _cells(self, patch: np.ndarray) -> np.ndarray | None:
        """Mean ink of each cell (letters x rows x columns), from -1 to 1, at the pitch that fits the glyphs best."""
        dark = 1.0 - patch.mean(axis=2) / 255.0
        rows, columns = np.flatnonzero(dark.max(axis=1) > 0.5), np.flatnonzero(dark.max(axis=0) > 0.5)
        if not len(rows) or not len(columns):
            return None
        unit = (rows[-1] - rows[0] + 1) / ROWS
        y = np.clip((rows[0] + (np.arange(ROWS) + 0.5) * unit).astype(int), 0, dark.shape[0] - 1)
        # All pitches at once: stretches x letters x cells.
        step = unit * np.linspace(0.93, 1.07, 29)
        n = np.maximum(1, np.ceil((columns[-1] - columns[0] + 1) / step / PITCH - 0.2)).astype(int)
        x = columns[0] + (np.arange(n.max())[:, None] * PITCH + np.arange(COLUMNS) + 0.5) * step[:, None, None]
        outside = x > dark.shape[1] - 1
        x = np.clip(x.astype(int), 0, dark.shape[1] - 1)
        cells = np.where(outside[:, :, None, :], -1.0, dark[y[None, None, :, None], x[:, :, None, :]] * 2 - 1)
        fits = (cells.reshape(len(step), n.max(), -1) @ self._templates.T).max(axis=2)
        best = int(np.argmax([float(fits[i, :k].mean()) for i, k in enumerate(n)]))
        return cells[best, : n[best]]

    def orient(self, patch: np.ndarray) -> np.ndarray:
        """How full the left and the right edges of letters are: each has its stem on the left, or on the right if it is turned."""
        gray = np.rint(patch / LINE_NORM + LINE_MEAN)
        used = np.flatnonzero((gray != PAD).any(axis=(0, 2)))
        if not len(used):
            return np.zeros(2)
        dark = 1.0 - gray[:, : used[-1] + 1].mean(axis=2) / 255.0
        dark /= max(float(dark.max()), 1e-6)
        rows = np.flatnonzero(dark.max(axis=1) > 0.5)
        if not len(rows):
            return np.zeros(2)
        full = dark[rows[0] : rows[-1] + 1].mean(axis=0)
        edge = np.flatnonzero(np.diff((full > 0.2).astype(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2] - 1
        near = lambda at, step: np.maximum(full[at], full[np.clip(at + step, 0, len(full) - 1)])
        return np.array([near(first, 1).mean(), near(last, -1).mean()]) if len(first) else np.zeros(2)

    def recognise(self, patch: np.ndarray) -> np.ndarray:
        """Two steps a letter: its class, then the blank, class 0."""
        cells = self._cells(np.rint(patch / LINE_NORM + LINE_MEAN))
        logits = np.zeros((1 if cells is None else 2 * len(cells), len(DICTIONARY) + 1))
        logits[:, 0] = 0.5
        if cells is not None:
            flat = cells.reshape(len(cells), -1)
            logits[::2, 1:-1] = (flat @ self._templates.T) / (ROWS * COLUMNS)
            logits[::2, -1] = np.where(flat.mean(axis=1) < -0.9, 1.0, 0.0)
            logits[::2, 0] = 0.0
        return logits

    def close(self) -> None:
        self._templates = None


class ReplayBackend:
    """Tensors by the order of calls."""

    def __init__(self, detect=(), orient=(), recognise=()):
        self._kept = {"detect": list(detect), "orient": list(orient), "recognise": list(recognise)}

    def load(self) -> None: ...

    def close(self) -> None: ...

    def _next(self, stage: str) -> np.ndarray:
        if not self._kept[stage]:
            code = {"detect": "detection", "orient": "orientation", "recognise": "recognition"}[stage]
            raise Refused(f"{code}-inference-failed", "nothing left to replay")
        return np.asarray(self._kept[stage].pop(0))

    def detect(self, image: np.ndarray) -> np.ndarray:
        return self._next("detect")

    def orient(self, patch: np.ndarray) -> np.ndarray:
        return self._next("orient")

    def recognise(self, patch: np.ndarray) -> np.ndarray:
        return self._next("recognise")


def greedy(logits: np.ndarray, dictionary: list[str], offset: int = 1) -> tuple[str, float]:
    """CTC decoding of a (steps x classes) array; a leading axis of one is dropped."""
    logits = logits[0] if logits.ndim == 3 and logits.shape[0] == 1 else logits
    if logits.ndim != 2 or logits.shape[0] < 1 or logits.shape[1] < 2:
        raise Refused("recognition-output-invalid", f"an array of {logits.shape} instead of steps by classes")
    if logits.shape[1] != len(dictionary) + offset:
        raise Refused("dictionary-mismatch", f"scores for {logits.shape[1]} classes, names and blanks for {len(dictionary) + offset}")
    classes, scores = logits.argmax(axis=1), logits.max(axis=1)
    keep = (classes > 0) & (classes != np.concatenate([[0], classes[:-1]])) & (classes - offset < len(dictionary))
    kept = scores[keep]
    return "".join(dictionary[c - offset] for c in classes[keep]), float(kept.mean()) if len(kept) else 0.0
