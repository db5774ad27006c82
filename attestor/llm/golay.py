"""The perfect binary Golay code (23, 12): its remainders and codewords."""

from __future__ import annotations

import numpy as np

#: Fixed value: generator polynomial.
GENERATOR = 0xC75


def remainder(x: int) -> int:
    """Remainder of a 23-bit word modulo the generator."""
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - 11)
    return x


def codebook() -> np.ndarray:
    """Bits of the 4,096 codewords, a row each, by their upper 12 bits."""
    words = np.array([(k << 11) | remainder(k << 11) for k in range(1 << 12)])
    return (words[:, None] >> np.arange(23)) & 1
