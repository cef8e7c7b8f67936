"""Words as TESTDATA.md counts them: runs of letters and digits, one Han character each, NFC, case ignored."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")


def nfc(text: str | None) -> str:
    if not text:
        return ""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return _WORD.findall(nfc(text).lower())


def hashes(distinct: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass"), seed) for w in distinct), np.uint64, len(distinct))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Splitmix finaliser: a fresh 64-bit hash of each hash."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Coder:
    """Numbers words within a task and keeps their hashes; forgets all when it has grown past its bound."""

    def __init__(self, bound: int = 400_000):
        self.bound, self.ids, self.h = bound, {}, np.zeros(0, np.uint64)

    def __call__(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of all docs in one array, and the docs' lengths."""
        if len(self.ids) > self.bound:
            self.ids, self.h = {}, np.zeros(0, np.uint64)
        ids, flat = self.ids, [w for d in docs for w in d]
        new = [w for w in dict.fromkeys(flat) if w not in ids]
        for w in new:
            ids[w] = len(ids)
        if new:
            self.h = np.concatenate([self.h, hashes(new)])
        at = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
        return self.h[at] if len(flat) else np.zeros(0, np.uint64), np.fromiter(map(len, docs), np.int64, len(docs))
