"""Keys under which 64-bit fingerprints that differ in few bits must meet."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_keys(fingerprint: Column, distance: int = 3, blocks: int = 5) -> Column:
    """An array of keys: 64 bits are cut into ``blocks`` blocks; ``distance`` differing bits leave at least
    ``blocks - distance`` of them equal, so two such fingerprints share the key of some choice of that many blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fingerprint.bitwiseAND(F.lit(mask))))
    return F.array(*keys)
