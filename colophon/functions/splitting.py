"""Texts cut into pieces of a bounded number of estimated tokens.

Separators have ranks: paragraphs, lines, sentences, words, characters. A text over the bound is cut at the first
rank, its parts are filled up in order, and a part that is itself over the bound is cut at the next rank. The estimate
of any part is the difference of two running sums, so no text is counted twice, and the end of a piece is found by
bisection: the time is linear in the text. A word that is cut counts again in each piece, so no piece is over the bound.
"""

from __future__ import annotations

import numpy as np
import regex

from colophon.functions.text import CJK_RANGES, CJK_WEIGHT, PUNCTUATION_WEIGHT, WORD_OR_NUMBER, WORD_WEIGHT

#: Weights as whole twentieths, so that sums are exact.
_UNIT = 20
_WORD, _PUNCTUATION, _CJK = (round(w * _UNIT) for w in (WORD_WEIGHT, PUNCTUATION_WEIGHT, CJK_WEIGHT))
_WORDS = regex.compile(WORD_OR_NUMBER)
#: What ends a part at each rank.
_RANKS = [regex.compile(p) for p in (r"\n\s*\n\s*", r"\n\s*", r"(?<=[.!?])\s+", r"\s+")]


class Counted:
    """A text with the running sum of its estimate."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        weight = np.zeros(len(codes) + 1, np.int32)
        ascii_ = codes < 128
        weight[1:] += np.int32(_PUNCTUATION) * (ascii_ & (codes > 32) & (codes < 127) & ~(((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))))
        wide = np.zeros(len(codes), bool)
        if not ascii_.all():
            for low, high in CJK_RANGES:
                wide |= (codes >= low) & (codes <= high)
        weight[1:] += np.int32(_CJK) * wide
        spans = np.array([m.span() for m in _WORDS.finditer(text)], np.int64).reshape(-1, 2)
        self.starts, self.ends = spans[:, 0], spans[:, 1]
        np.add.at(weight, self.starts + 1, _WORD)
        self.text, self.sum = text, np.cumsum(weight, dtype=np.int64)

    def before(self, a: int) -> int:
        """The sum that a piece from ``a`` on begins with: less by a word if ``a`` lies inside one, which counts again."""
        k = int(np.searchsorted(self.starts, a, "left")) - 1
        return int(self.sum[a]) - (_WORD if k >= 0 and a < self.ends[k] else 0)

    def tokens(self, a: int, b: int) -> int:
        """The estimate of a part, at least 1; of a part that begins inside a word at most one word too many."""
        return max(1, -(-(int(self.sum[b]) - self.before(a)) // _UNIT))

    def reach(self, a: int, most: int) -> int:
        """The furthest end of a piece from ``a`` on."""
        return int(np.searchsorted(self.sum, self.before(a) + most * _UNIT, "right")) - 1


def estimate(text: str) -> int:
    """``text.token_estimate`` for one Python string."""
    return Counted(text).tokens(0, len(text)) if text.strip() else 0


def split_spans(text: str, most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Start and end of each piece. With ``overlap`` a piece begins with up to that many tokens of whole words before it.

    A character can weigh two tokens, so ``most`` less ``overlap`` must be 2 or more.
    """
    if most - overlap < 2 or overlap < 0:
        raise ValueError("most must be 2 or more over overlap")
    counted, bound = Counted(text), most - overlap
    cuts = [np.array([m.end() for m in r.finditer(text)] + [len(text)], np.int64) for r in _RANKS]
    out: list[tuple[int, int]] = []

    def emit(a: int, b: int) -> None:
        body = text[a:b]
        left = a + len(body) - len(body.lstrip())
        right = b - (len(body) - len(body.rstrip()))
        if right > left:
            out.append((left, right))

    def cut(a: int, b: int, rank: int) -> None:
        while a < b:
            end = min(counted.reach(a, bound), b)
            if end >= b:
                emit(a, b)
                return
            if rank == len(cuts):
                emit(a, max(end, a + 1))
                a = max(end, a + 1)
                continue
            i = int(np.searchsorted(cuts[rank], end, "right")) - 1
            best = int(cuts[rank][i]) if i >= 0 else 0
            if best > a:
                emit(a, best)
                a = best
            else:
                # The part here is over the bound by itself.
                part = min(int(cuts[rank][np.searchsorted(cuts[rank], a, "right")]), b)
                cut(a, part, rank + 1)
                a = part

    cut(0, len(text), 0)
    if not overlap:
        return out
    words = cuts[-1]
    wider = out[:1]
    for a, b in out[1:]:
        least = counted.sum[a] - overlap * _UNIT
        i = int(np.searchsorted(words, np.searchsorted(counted.sum, least, "left"), "left"))
        start = int(words[i])
        wider.append((start if start < a and counted.tokens(start, b) <= most else a, b))
    return wider


def split_text(text: str, most: int, overlap: int = 0) -> list[str]:
    return [text[a:b] for a, b in split_spans(text, most, overlap)]
