"""Splitting texts into the pieces that byte-level BPE encodes one by one.

The fast path takes texts of code points below 256, many at once, with numpy: runs of one class (letters, numbers, white space, other),
corrected for the rules of the published pattern. Other texts go through the pattern itself.
"""

from __future__ import annotations

import numpy as np
import regex

from .common import kept_in_worker

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each code point below 256."""
    tests = ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE))
    return np.array([next((k for p, k in tests if regex.match(p, chr(c))), OTHER) for c in range(256)], np.uint8)


def narrow_pieces(texts: list[bytes]) -> list[list[str]]:
    """Pieces of texts given in Latin-1."""
    joined = b"\x00".join(texts) + b"\x00"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = kept_in_worker("classes", _classes)[data]
    kind[ends] = END
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[ends] = True
    change[ends[:-1] + 1] = True
    # white space before other text: its last character stands alone, or joins the text if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < END) & (kind[1:] != SPACE))
    change[last] = True
    change[last[data[last] == 32] + 1] = False
    # contractions: a lone apostrophe that starts a piece takes s, t, re, ve, m, ll or d with it
    mark = np.flatnonzero((data[:-1] == 39) & change[:-1])
    for at in mark[kind[mark + 1] == LETTER].tolist():
        if joined[at + 1] in b"stmd":
            n = 1
        elif joined[at + 1:at + 3] in (b"re", b"ve", b"ll"):
            n = 2
        else:
            continue
        change[at + 1] = False
        change[at + 1 + n] = True
    starts = np.flatnonzero(change)
    cut = np.searchsorted(starts, ends)
    places, string, out, lo = starts.tolist(), joined.decode("latin-1"), [], 0
    for hi in cut.tolist():
        out.append([string[a:b] for a, b in zip(places[lo:hi], places[lo + 1:hi + 1])])
        lo = hi + 1
    return out


def split(texts: list[str], pattern: str) -> list[list[str]]:
    """Pieces of each text, exactly the successive matches of ``pattern`` (``public_tokenizers.PATTERN``)."""
    out: list[list[str] | None] = [None] * len(texts)
    narrow: list[bytes] = []
    places: list[int] = []
    for i, text in enumerate(texts):
        try:
            narrow.append(text.encode("latin-1"))
            places.append(i)
        except UnicodeEncodeError:
            out[i] = regex.findall(pattern, text)
    if narrow:
        for i, found in zip(places, narrow_pieces(narrow)):
            out[i] = found
    return out
