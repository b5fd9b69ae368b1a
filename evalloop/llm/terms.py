"""Words and hashed character n-grams for the text models; small helpers inside tasks."""

from __future__ import annotations

import re
from zlib import crc32

#: Runs of letters (and of the letter-like numbers that no model needs to tell apart).
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Remembered(dict):
    """``make(key)`` for each key, remembered in two generations of at most ``most`` entries each."""

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def gram_slots(word: str, sizes: tuple[int, ...], slots: int) -> list[int]:
    """Slots of the n-grams of a word with its ends marked."""
    marked = f"^{word}$"
    return [crc32(marked[k:k + n].encode()) % slots for n in sizes for k in range(len(marked) - n + 1)]
