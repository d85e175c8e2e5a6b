"""One keying slip: minwise keys that bring such texts together, and the exact test.

A slip is one character wrong, missing or too many, or two neighbours swapped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def minwise(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` minwise values and the signature of each text, over its characters numbered by occurrence.

    A swap leaves this set as it is, and any other slip changes one element or
    two, so texts of n characters one slip apart are alike by (n - 1) / (n + 1) or more.
    The signature is an odd sketch, the parities of the elements' 64 hash classes:
    such texts differ in two of its bits at most.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full((len(texts), size), np.iinfo(np.int64).max, np.int64)
    sketch = np.zeros(len(texts), np.int64)
    if not len(codes):
        return out, sketch
    of = np.repeat(np.arange(len(texts)), lengths)
    order = np.lexsort((codes, of))
    c, o = codes[order], of[order]
    first = np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])]
    start = np.flatnonzero(first)
    nth = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    element = c * np.uint64(1 << 20) + nth.astype(np.uint64)
    filled = np.flatnonzero(lengths)
    heads = np.r_[0, np.cumsum(lengths[filled])[:-1]]
    for seed in range(size):
        out[filled, seed] = np.minimum.reduceat(_mix(element + np.uint64((seed + 1) * _STEP & _ALL)), heads).view(np.int64)
    bits = np.uint64(1) << (_mix(element) >> np.uint64(58))
    sketch[filled] = np.bitwise_xor.reduceat(bits, heads).view(np.int64)
    return out, sketch


_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(mins: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """One 64-bit key for each minwise value, its place and the agreeing value."""
    place = np.arange(1, mins.shape[1] + 1, dtype=np.uint64) * np.uint64(_STEP)
    return _mix(_mix(mins.view(np.uint64) + place[None, :]) + agree.astype(np.int64).view(np.uint64)[:, None]).view(np.int64)


def alike(a: Column, b: Column) -> Column:
    """Whether two signatures may belong to texts one slip apart; never false for such texts."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2


def deletions(text: Column) -> Column:
    """Hashes of the text and of all texts with one character less: any two texts one slip apart share one."""
    less = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.xxhash64(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), less))


def one_slip(a: Column, b: Column) -> Column:
    """Whether two texts are equal or one slip apart."""
    near = F.levenshtein(a, b, 2)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return near.between(0, 1) | F.when((near == 2) & (F.length(a) == F.length(b)), swapped).otherwise(F.lit(False))
