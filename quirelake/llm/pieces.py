"""Splitting oversized items at natural boundaries (problem 2).

A recursive hierarchy of separators (section, paragraph, line, sentence, clause, word, character) cuts a text
into atoms; only an atom that is still too long goes down one level. Atoms are packed greedily up to the limit and
each piece after the first starts about ``overlap`` characters before the end of the one before it, at a
sentence start if there is one near, else at a word start.

Lengths and positions count code points. A text within the limit is one piece; an empty text is one empty piece; a null
text gives no piece. No text is cut short, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6_000, 200

#: From coarse to fine; each matches a separator, and the cut falls at the end of the match.
_LEVELS = [
    re.compile(p)
    for p in (
        r"\f+|\n[ \t]*\n[ \t]*\n\s*|\n[ \t]*(?:[*#~=_-][ \t]*){3,}\n+",
        r"\n[ \t]*\n\s*",
        r"\n",
        r"[.!?…]+[\"'”’»)\]]*\s+|[。！？．｡।॥]+[」』”’》）]*\s*",
        r"[,;:–—、，；：]\s+|[、，；：]",
        r"\s+",
    )
]
_SENTENCE, _WORD = _LEVELS[3], re.compile(r"\s+")


def atoms(text: str, lo: int, hi: int, most: int, level: int = 0) -> list[int]:
    """Cut positions in (lo, hi], the last one hi, such that no atom is longer than ``most``."""
    if hi - lo <= most:
        return [hi]
    if level == len(_LEVELS):
        return [*range(lo + most, hi, most), hi]
    cuts, at = [], lo
    ends = [m.end() for m in _LEVELS[level].finditer(text, lo, hi) if m.end() < hi]
    for end in [*ends, hi]:
        if end > at:
            cuts += [end] if end - at <= most else atoms(text, at, end, most, level + 1)
            at = end
    return cuts


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The (start, end) of each piece, in order; pieces cover the text without gaps."""
    if overlap < 0 or limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    slack = overlap // 4
    cuts = atoms(text, 0, n, limit - overlap - slack)
    out, start, i = [], 0, 0
    while True:
        i = max(i, bisect_right(cuts, start + limit) - 1)
        end = cuts[i]
        # an atom boundary that leaves the piece less than half full gives way to a finer one
        if end < n and end - start < limit // 2:
            finer = [c for c in atoms(text, end, min(n, start + limit), max(1, limit // 8)) if c <= start + limit]
            finer = [c for c in finer[:-1] if c - start <= limit] or finer
            end = finer[-1] if finer else end
        out.append((start, end))
        if end >= n:
            return out
        start = _restart(text, out[-1][0], end, overlap, slack) if overlap else end


def _restart(text: str, lo: int, end: int, overlap: int, slack: int) -> int:
    """Where the next piece begins: a sentence start, else a word start, near ``end - overlap``."""
    aim = end - overlap
    for pattern in (_SENTENCE, _WORD):
        near = [m.end() for m in pattern.finditer(text, max(lo + 1, aim - slack - 80), min(end, aim + slack + 80))]
        near = [p for p in near if lo < p < end and abs(p - aim) <= slack]
        if near:
            return min(near, key=lambda p: (abs(p - aim), p))
    return max(lo + 1, aim)


def piece_table(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """DataFrame (key, text) -> (key, piece_no, n_pieces, start_pos, end_pos[, piece])."""
    kind = df.schema[key].dataType.simpleString()
    cols = [key, "piece_no", "n_pieces", "start_pos", "end_pos"] + ["piece"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if t is None:
                    continue
                got = split(t, limit, overlap)
                rows += [(k, j, len(got), s, e, *([t[s:e]] if with_text else [])) for j, (s, e) in enumerate(got)]
            yield pd.DataFrame(rows, columns=cols)

    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start_pos int, end_pos int" + (", piece string" if with_text else "")
    return df.select(F.col(key), F.col(text)).mapInPandas(run, schema)
