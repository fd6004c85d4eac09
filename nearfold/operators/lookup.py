"""Packed scalar codes and distances by table lookup, for whole Arrow batches.

A query's table holds the squared difference of each of its components to each
level. Codes of a byte are looked up together: a byte's table has 256 entries,
each the sum over the components that the byte codes. A distance is then one
lookup and addition for each byte of a code.
"""

from __future__ import annotations

import numpy as np


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes below 2^bits as rows of bytes, the first code lowest; bits divides 8. The last byte is filled with zeros."""
    per = 8 // bits
    n, d = codes.shape
    full = np.zeros((n, -(-d // per) * per), np.uint8)
    full[:, :d] = codes
    shifts = (np.arange(per) * bits).astype(np.uint8)
    return (full.reshape(n, -1, per) << shifts).sum(axis=2, dtype=np.uint8)


def unpack(packed: np.ndarray, bits: int, d: int) -> np.ndarray:
    shifts = (np.arange(8 // bits) * bits).astype(np.uint8)
    codes = (packed[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)
    return codes.reshape(len(packed), -1)[:, :d]


def level_table(q: np.ndarray, levels) -> np.ndarray:
    """(component, level): squared differences."""
    return (np.asarray(q, np.float64)[:, None] - np.asarray(levels, np.float64)[None, :]) ** 2


def byte_tables(table: np.ndarray, bits: int) -> np.ndarray:
    """(byte, 256): what each value of each byte adds to the distance. Components that fill the last byte add nothing."""
    per = 8 // bits
    d, levels = table.shape
    full = np.zeros((-(-d // per) * per, 1 << bits))
    full[:d, :levels] = table
    values = (np.arange(256)[:, None] >> (np.arange(per) * bits)) & ((1 << bits) - 1)
    return full.reshape(-1, per, 1 << bits)[:, np.arange(per), values].sum(axis=2)


def distances(packed: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Of each row of bytes to the query of these tables."""
    out = np.zeros(len(packed))
    for b in range(packed.shape[1]):
        out += tables[b][packed[:, b]]
    return out


def bytes_matrix(column) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    n = len(column)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(n, -1)


def quantised(x: np.ndarray, levels) -> np.ndarray:
    """Index of the nearest of ascending levels for each component; half-way, the upper one."""
    levels = np.asarray(levels, np.float64)
    return np.searchsorted((levels[1:] + levels[:-1]) / 2, x, side="right").astype(np.uint8)
