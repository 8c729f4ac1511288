"""Spaced seed shapes."""

from __future__ import annotations

# Seed shapes by sensitivity; 1 marks positions that enter the key.
SHAPES = {
    "faster": ["1101110101101111"],
    "fast": ["1101110101101111"],
    "default": ["111101110111", "111011010010111"],
    "mid-sensitive": ["11110110111", "1101100111101", "1110010101111", "11010101100111", "11101110001011", "1110100100010111", "1101000011010111", "1110011000011011"],
    "sensitive": [
        "1011110111",
        "110100100010111",
        "11001011111",
        "101110001111",
        "11011101100001",
        "1111010010101",
        "111001001001011",
        "10101001101011",
        "111101010011",
        "1111000010000111",
        "1100011011011",
        "1101010000011011",
        "1110001010101001",
        "110011000110011",
        "11011010001101",
        "1101001100010011",
    ],
    "very-sensitive": [
        "11101111",
        "110110111",
        "111111001",
        "1010111011",
        "11110001011",
        "110100101011",
        "110110001101",
        "1010101000111",
        "1100101001011",
        "1101010101001",
        "1110010010011",
        "110110000010011",
        "111001000100011",
        "1101000100010011",
    ],
    "shapes-6x10": ["10111111111", "111110110111", "1101110111011", "111111101011", "1111011110011", "111111100100011"],
}
SHAPES["more-sensitive"] = SHAPES["sensitive"]

# Identities asked for in the 48-letter window, and entropy cut of seeds, by sensitivity.
LEAST_IDENTITIES = {"very-sensitive": 9, "ultra-sensitive": 9}
SEED_CUT = {"faster": 0.9, "fast": 0.9, "default": 0.8}

#: Levels that an iterated search runs through before the one asked for.
ITERATED = {"default": ["fast"], "mid-sensitive": ["fast", "default"], "sensitive": ["fast", "default"], "more-sensitive": ["fast", "default"], "very-sensitive": ["fast", "default", "more-sensitive"]}


def least_identities(level: str, approx_id: float = 0.0) -> int:
    base = LEAST_IDENTITIES.get(level, 11)
    return max(base, 30 if approx_id >= 90 else 20 if approx_id >= 50 else 0)


def runs(shape: str) -> list[tuple[int, int]]:
    """(offset, length) of each run of ones."""
    out, i = [], 0
    while i < len(shape):
        if shape[i] == "1":
            j = i
            while j < len(shape) and shape[j] == "1":
                j += 1
            out.append((i, j - i))
            i = j
        else:
            i += 1
    return out
