"""Elias-Fano sequences over numpy arrays, with vectorised access, and files of named arrays that are memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyarrow import fs

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th one of a byte.
_PLACE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, least significant first, as 64-bit words, one spare word after them."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros((len(packed) + 7) // 8 + 1, np.uint64)
    out.view(np.uint8)[: len(packed)] = packed
    return out


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits in unary, a count of ones before every word."""

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray, width: int, count: int):
        self.low, self.high, self.before, self.width, self.count = low, high, before, width, count

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(int(values[-1] + np.uint64(1)) // n).bit_length() - 1) if n else 0
        if width:
            low = _words(np.hstack([((values >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)[:, None] for k in range(width)]).reshape(-1))
        else:
            low = np.zeros(1, np.uint64)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        high = _words(bits)
        ones = _ONES[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return cls(low, high, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32), width, n)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.before": self.before, f"{name}.shape": np.array([self.width, self.count], np.uint64)}

    @classmethod
    def decode(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        width, count = arrays[f"{name}.shape"].tolist()
        return cls(arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.before"], int(width), int(count))

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one among the high bits."""
        word = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        rest = i - self.before[word]
        octets = self.high[word].view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_ONES[octets], axis=1, dtype=np.uint8)
        at = (sums <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        rest = rest - np.where(at > 0, sums[rows, np.maximum(at - 1, 0)], 0)
        return word * 64 + at * 8 + _PLACE[octets[rows, at], rest]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        value = (self._select(i) - i) << self.width
        if self.width:
            place = i * self.width
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            bits = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
            value |= (bits & np.uint64((1 << self.width) - 1)).astype(np.int64)
        return value

    def successor(self, first: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Index of the first value not below the target within [first, end) of each query; ``end`` if there is none."""
        low, high = first.copy(), end.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            below = self.at(middle) < target[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
        return low


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Write named arrays to one file; returns its bytes."""
    place, table = 0, {}
    for name, a in arrays.items():
        table[name] = (place, a.dtype.str, len(a))
        place += -(-a.nbytes // 8) * 8
    head = json.dumps(table).encode()
    head += b" " * (-len(head) % 8)
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    return 8 + len(head) + place


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a file, memory-mapped. Files of a store that cannot be mapped are fetched; nothing of them stays behind."""
    files, path = fs.FileSystem.from_uri(uri)
    if isinstance(files, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local:  # the mapping outlives the name
            with files.open_input_stream(path, compression=None) as source:
                while chunk := source.read(8 << 20):
                    local.write(chunk)
            local.flush()
            data = np.memmap(local.name, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    table = json.loads(data[8 : 8 + size].tobytes())
    return {name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in table.items()}
