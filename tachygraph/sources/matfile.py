"""Level-5 MAT files: numeric and character arrays, compressed or not, read and written with numpy alone."""

from __future__ import annotations

import struct
import zlib
from io import BytesIO

import numpy as np

#: Fixed values of the published format: data types of elements, and array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
_CLASSES = {4: "char", 6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED = 14, 15


def _element(buf: BytesIO, order: str) -> tuple[int, bytes] | None:
    head = buf.read(8)
    if len(head) < 8:
        return None
    kind, size = struct.unpack(order + "II", head)
    if kind >> 16:
        return kind & 0xFFFF, head[4 : 4 + (kind >> 16)]
    data = buf.read(size)
    if kind != COMPRESSED and size % 8:
        buf.read(8 - size % 8)
    return kind, data


def _array(data: bytes, order: str) -> tuple[str, np.ndarray] | None:
    buf = BytesIO(data)
    parts = []
    while (x := _element(buf, order)) is not None and len(parts) < 4:
        parts.append(x)
    if len(parts) < 4:
        return None
    sort = struct.unpack(order + "I", parts[0][1][:4])[0] & 0xFF
    shape = np.frombuffer(parts[1][1], order + "i4")
    if sort not in _CLASSES:
        return None
    values = np.frombuffer(parts[3][1], order + TYPES[parts[3][0]])
    if _CLASSES[sort] == "char":
        return parts[2][1].decode(), np.array("".join(map(chr, values)))
    return parts[2][1].decode(), values.astype(_CLASSES[sort]).reshape(tuple(shape), order="F")


def loads(blob: bytes) -> dict[str, np.ndarray]:
    """All numeric and character arrays of a file, by name."""
    order = "<" if blob[126:128] == b"IM" else ">"
    buf, out = BytesIO(blob[128:]), {}
    while (x := _element(buf, order)) is not None:
        kind, data = x
        if kind == COMPRESSED:
            inner = _element(BytesIO(zlib.decompress(data)), order)
            if inner is None:
                continue
            kind, data = inner
        if kind == MATRIX and (found := _array(data, order)) is not None:
            out[found[0]] = found[1]
    return out


START = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"


def _packed(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def opening(name: str, shape: tuple[int, int]) -> bytes:
    """What stands in a file before the numbers of an array of doubles, whose bytes follow column by column."""
    size = 8 * shape[0] * shape[1]
    front = _packed(6, struct.pack("<II", 6, 0)) + _packed(5, np.array(shape, "<i4").tobytes()) + _packed(1, name.encode()) + struct.pack("<II", 9, size)
    return struct.pack("<II", MATRIX, len(front) + size) + front


def dumps(arrays: dict[str, np.ndarray]) -> bytes:
    """A file of double arrays."""
    out = START
    for name, values in arrays.items():
        values = np.atleast_2d(np.asarray(values, float))
        out += opening(name, values.shape) + values.tobytes(order="F")
    return out
