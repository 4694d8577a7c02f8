"""Words of texts in any script; hashes of words and of word sequences of many texts at once, in numpy."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: ASCII characters that are neither letters nor digits become spaces.
NORMAL = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Only ASCII white space separates words.
PLAIN = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))

#: Thai, Lao, Tibetan, Burmese, Khmer, Kana, Han, which are written without spaces.
UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
)


def _marks() -> str:
    """Ranges of all combining marks, for a character class."""
    found = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c, before in zip(found, [-1, *found]) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -1]) if c != after - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: What separates words, but for spaces: all that is neither letter, digit nor combining mark.
APART = re.compile(f"[^\\w {_marks()}]+|_+")


def spaced(text: str) -> str:
    """The text in lower case with only spaces, or ASCII characters other than letters and digits, between words.

    Words are runs of letters and digits with their marks; in scripts without spaces each character is a word.
    """
    text = text.lower()
    if text.isascii():
        return text
    text = APART.sub(" ", text)
    return UNSPACED.sub(r" \g<0> ", text) if UNSPACED.search(text) else text


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE, np.uint64)]))
        return self.up, self.down


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(28))


def word_hashes(texts: list[bytes], separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and in all, start byte of each word in the joined texts).

    ``separators`` is a table for ``bytes.translate`` that turns what separates words into spaces.
    """
    joined = b" ".join([*texts, b""]).translate(separators)
    data = np.frombuffer(joined, np.uint8)
    gap = np.concatenate([[True], data == 32])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, edges), starts


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes, by doubling; shorter input gives none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, out, at, size, power = BASE, None, 0, 1, hashes
    rest = width
    with np.errstate(over="ignore"):
        step = np.uint64(factor)
        while rest:
            if rest & 1:
                part = power[at : at + n]
                out = part.copy() if out is None else out * step + part
                at += size
            rest >>= 1
            if rest:
                power = power[: len(power) - size] * step + power[size:]
                step, size = step * step, size * 2
    return mixed(out + np.uint64(width))
