"""NumPy kernels on the UTF-8 bytes of whole columns of text.

Everything works on concatenated bytes, so cost is a few array passes per
byte and no Python object is made for a word. Slices bound the temporaries, so
one very long text costs a small multiple of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SLICE = 1 << 20
_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte, so that the structure of texts does not show in the hashes.
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


_POWERS = _powers(_BASE, 1024)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    valid = np.asarray(column.is_valid())
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), valid
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    first = offsets[0]
    raw = np.frombuffer(data, np.uint8)[first : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - first
    if not valid.all():  # a null may own bytes
        lengths = np.diff(offsets)
        if lengths[~valid].any():
            keep = np.repeat(valid, lengths)
            raw = raw[keep]
            offsets = np.concatenate([[0], np.cumsum(np.where(valid, lengths, 0))])
    return raw, offsets, valid


class Words:
    """All words of a column of texts, in order: where each lies, whose it is, its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        starts, ends, hashes = [], [], []
        begin, total = 0, len(data)
        while begin < total:
            end = min(total, begin + _SLICE)
            while end < total and not SPACE[data[end]] and not self._boundary(end):
                more = data[end : end + 4096]
                gap = np.flatnonzero(SPACE[more])
                nearest = self.offsets[np.searchsorted(self.offsets, end)]
                end = min(end + (int(gap[0]) if len(gap) else len(more)), int(nearest), total)
            s, e, h = self._slice(begin, end)
            starts.append(s), ends.append(e), hashes.append(h)
            begin = end
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: Words of text d are those from first[d] to first[d + 1].
        self.first = np.searchsorted(self.start, offsets)

    def _boundary(self, at: int) -> bool:
        i = np.searchsorted(self.offsets, at)
        return i < len(self.offsets) and self.offsets[i] == at

    def _slice(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = self.data[begin:end]
        inside = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        cuts = self.offsets[np.searchsorted(self.offsets, begin) : np.searchsorted(self.offsets, end, "right")] - begin
        edge[cuts] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, ~inside[1:]
        s = np.flatnonzero(inside & (before | edge[:-1]))
        e = np.flatnonzero(inside & (after | edge[1:])) + 1
        return s + begin, e + begin, span_hashes(part, s, e)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of bytes; equal bytes have equal hashes wherever they lie."""
    global _POWERS
    n = len(data)
    if not n or not len(starts):
        return np.empty(len(starts), np.uint64)
    if len(_POWERS) < n:
        _POWERS = _powers(_BASE, max(n, 2 * len(_POWERS)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[:n], out=total[1:])
    raw = total[ends] - total[starts]
    return mix(raw * _inverse_powers(n)[starts] + (ends - starts).astype(np.uint64))


_INVERSES = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = _powers(_BASE_INVERSE, max(n, 1024))
    return _INVERSES


def chunks(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(column).cast(pa.float64()))) if len(column) else np.empty(0)
    begin, held = 0, 0.0
    for i, size in enumerate(lengths):
        if i > begin and held + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0.0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
