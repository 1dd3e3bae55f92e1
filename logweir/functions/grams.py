"""Which three-byte runs a file's lines hold, as a small bitmap: a file without a run of the needle can't hold it."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 1 << 16
_MIX = np.uint32(0x9E3779B1)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint32)


def places(text: np.ndarray) -> np.ndarray:
    """Bit of every run of three bytes, ASCII letters in lower case."""
    low = _LOWER[text]
    runs = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    return (runs * _MIX) >> np.uint32(16)


def bitmap(seen: np.ndarray) -> list[int]:
    """A row of BITS flags as 64-bit numbers, lowest bit first."""
    return np.packbits(seen, bitorder="little").view(np.int64).tolist()


def may_hold(needle: str, grams: str = "grams") -> Column:
    """No run of the needle, in lower case as search compares it, is known to be absent."""
    raw = np.frombuffer(needle.lower().encode("utf-8"), np.uint8)
    bits = sorted(set(places(raw).tolist())) if len(raw) >= 3 else []
    if not bits:
        return F.lit(True)
    asked = F.array(*[F.lit(b) for b in bits])
    return F.forall(asked, lambda b: F.getbit(F.get(F.col(grams), F.floor(b / 64).cast("int")), b % 64) == 1)
