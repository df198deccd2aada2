"""Pages made by rule: text set in ruled glyphs, degraded in named ways, written as PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

from pagewright.backends import COLUMNS, LETTERS, PITCH, ROWS, glyph

#: Fixed value: the seed of the noise.
NOISE_SEED = 7


#: Letters' widths of a space: boxes grow into it from both sides, and it must still be seen.
SPACE = 3


def render(lines: Sequence[str], unit: int = 3, pad: int = 12, leading: int = 6, *, letters: str | None = LETTERS, right_to_left: bool = False) -> np.ndarray:
    """A white page with the lines in black, ``unit`` pixels a cell, from the left or the right.

    Letters other than ``letters`` are left out; without such a list all are drawn.
    """
    lines = ["".join(c for c in line if letters is None or c in letters or c == " ") for line in lines]
    widest = max([len(x) + (SPACE - 1) * x.count(" ") for x in lines], default=0)
    pitch = (ROWS + leading) * unit
    page = np.full((2 * pad + max(1, len(lines)) * pitch, 2 * pad + max(1, widest) * PITCH * unit, 3), 255, np.uint8)
    for row, line in enumerate(lines):
        at = 0
        for letter in line:
            at += SPACE if letter == " " else 1
            if letter != " ":
                y, x = pad + row * pitch, pad + (at - 1) * PITCH * unit
                if right_to_left:
                    x = page.shape[1] - x - COLUMNS * unit
                ink = np.kron(glyph(letter), np.ones((unit, unit), bool))
                page[y : y + ROWS * unit, x : x + COLUMNS * unit][ink] = 0
    return page


def skewed(page: np.ndarray, degrees: float) -> np.ndarray:
    from pagewright.operators.pixels import sample

    h, w = page.shape[:2]
    t = np.radians(degrees)
    grown = int(abs(np.sin(t)) * max(h, w)) + 2
    padded = np.pad(page, ((grown, grown), (grown, grown), (0, 0)), constant_values=255)
    y, x = np.mgrid[0 : padded.shape[0], 0 : padded.shape[1]]
    cy, cx = padded.shape[0] / 2, padded.shape[1] / 2
    return sample(padded, cx + (x - cx) * np.cos(t) + (y - cy) * np.sin(t), cy - (x - cx) * np.sin(t) + (y - cy) * np.cos(t))


def blurred(page: np.ndarray, size: int = 3) -> np.ndarray:
    kernel = np.exp(-0.5 * ((np.arange(size) - size // 2) / (0.3 * ((size - 1) * 0.5 - 1) + 0.8)) ** 2)
    kernel /= kernel.sum()
    data = np.pad(page.astype(float), ((size // 2,) * 2, (size // 2,) * 2, (0, 0)), mode="edge")
    data = sum(k * data[i : i + page.shape[0]] for i, k in enumerate(kernel))
    data = sum(k * data[:, i : i + page.shape[1]] for i, k in enumerate(kernel))
    return np.clip(np.rint(data), 0, 255).astype(np.uint8)


def noisy(page: np.ndarray, sigma: float = 25.0) -> np.ndarray:
    return np.clip(page + np.random.default_rng(NOISE_SEED).normal(0, sigma, page.shape), 0, 255).astype(np.uint8)


def faded(page: np.ndarray, factor: float = 0.7) -> np.ndarray:
    return (255 - (255 - page.astype(float)) * factor).astype(np.uint8)


def _cosines() -> np.ndarray:
    """The 8-point cosine transform as a matrix (orthonormal)."""
    k = np.arange(8)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after its 8 x 8 blocks' cosine coefficients were rounded to multiples of ``table``; edges are repeated to whole blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    c = _cosines()
    kept = np.rint(c @ blocks @ c.T / table) * table
    return ((c.T @ kept @ c).swapaxes(1, 2).reshape(padded.shape) + 128)[:h, :w]


def lossy(page: np.ndarray, quality: int = 40) -> np.ndarray:
    """What a lossy codec leaves: luma and halved chroma, 8 x 8 cosine transforms, coefficients rounded the coarser the higher their frequency and the lower the quality (1 to 100).

    The transform codec itself, without entropy coding, which loses nothing. The
    quantisation table is a rule of its own, so files of other codecs differ.
    """
    if not 1 <= quality <= 100:
        raise ValueError("a quality of 1 to 100")
    share = (50 / quality if quality < 50 else 2 - quality / 50) or 0.01
    u, v = np.mgrid[0:8, 0:8]
    table = np.maximum(1.0, np.floor((10 + 6 * (u + v) + (u * v)) * share + 0.5))
    rgb = page.astype(float)
    luma = rgb @ np.array([0.299, 0.587, 0.114])
    out = [_coded(luma, table)]
    h, w = luma.shape
    for channel, scale in ((2, 1.772), (0, 1.402)):
        plane = np.pad((rgb[..., channel] - luma) / scale + 128, ((0, h % 2), (0, w % 2)), mode="edge")
        half = _coded(plane.reshape(plane.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)), np.minimum(table * 1.5, 255))
        out.append(np.kron(half, np.ones((2, 2)))[:h, :w] - 128)
    y, blue, red = out
    b, r = y + 1.772 * blue, y + 1.402 * red
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(np.stack([r, g, b], axis=-1)), 0, 255).astype(np.uint8)


VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "clean": lambda page: page,
    "skew-2deg": lambda page: skewed(page, 2.0),
    "blur-3px": lambda page: blurred(page, 3),
    "noise-sigma25": noisy,
    "faded-70pc": faded,
    "lossy-q40": lossy,
    "upside-down": lambda page: page[::-1, ::-1],
}


def png(page: np.ndarray) -> bytes:
    """A page as PNG."""
    if page.ndim != 3 or page.shape[2] != 3 or page.dtype != np.uint8 or not page.size:
        raise ValueError("a page is a non-empty uint8 array of height x width x 3")
    h, w = page.shape[:2]
    raw = b"".join(b"\0" + page[y].tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
