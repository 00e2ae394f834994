"""Character trigrams of texts, exact in 63 bits, whatever the script."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of a code point.
BITS = 21
BLOCK = 1 << 21


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each character of each text (two zeros stand before), and the texts' lengths."""
    parts, zeros = [], np.zeros(2, np.int64)
    for t in texts:
        s = np.concatenate([zeros, code_points(t)])
        parts.append((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:])
    return np.concatenate(parts) if parts else zeros[:0], np.asarray([p.size for p in parts], np.int64)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of values over consecutive runs of these lengths."""
    ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    return ends[at[1:]] - ends[at[:-1]]


def blocks(texts: Iterator[str], most: int = BLOCK) -> Iterator[list[str]]:
    """Lists of texts of about so many characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
