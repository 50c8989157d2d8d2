"""One consistent form for text that prints alike (problem 3).

Arrow text is copied into numpy code-point arrays; every step is a table gather or an array operation on
a whole block of rows:

1. table gather with expansion offsets: canonical and compatibility decompositions that do not change
   how text looks (full width, half width, ligatures, no-break forms, presentation forms), blanks,
   invisible characters (expansion of length 0) and look-alike letters;
2. look-alike letters go to the script of their word: that of its other letters, which every spelling of the word
   shares, or, where it has none, Latin if a letter is one that other scripts rarely have, else that of the nearest word
   before (else after) it that is decided;
3. canonical ordering of marks (one stable sort of the block, only if some mark is out of order);
4. repeated composition of neighbouring pairs by binary search in the sorted table of pairs.

Super- and subscripts, fractions and circled forms stay as they are: they look different.

Nulls stay null, an empty text stays empty, texts of any length are processed whole (a block holds whole
rows and at least one).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; bounds the memory of a Python worker, not the length of a text.
BLOCK = 1_000_000

# Letters of other scripts that are drawn like a Latin letter, and that letter.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ɡ": "g", "‐": "-", "‑": "-",
}
#: Scripts that share letters; an undecided text is Latin.
LATIN, CYRILLIC, GREEK = 1, 2, 3
#: Shared letters that other scripts than Latin rarely have.
_RARE = np.array([ord(c) for c in "dhqwsQWS"])
#: Kinds of compatibility decomposition that leave the look of a character as it is.
_ALIKE_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _expand(ch: str) -> str:
    """The sequence a character stands for, fully decomposed."""
    kind = unicodedata.category(ch)
    cp = ord(ch)
    if kind == "Cf" or cp in _INVISIBLE:
        return ""
    if kind == "Zs" or ch in "\t\x0b":
        return " "
    if ch in "\x85\u2028\u2029\x0c":
        return "\n"
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    if 0xAC00 <= cp <= 0xD7A3:
        return ch
    made = unicodedata.decomposition(ch)
    if not made:
        return ch
    if made[0] == "<":
        tag, _, made = made.partition(" ")
        if tag not in _ALIKE_TAGS or made.startswith("0020 "):
            return ch
    return "".join(_expand(chr(int(x, 16))) for x in made.split())


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    size = 0x110000
    first, count, ccc = np.arange(size, dtype=np.int32), np.ones(size, np.uint8), np.zeros(size, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for cp in range(size):
        if 0xD800 <= cp < 0xE000 or 0x30000 <= cp < 0xE0000 or cp >= 0xF0000:
            continue
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            ccc[cp] = c
        out = _expand(ch)
        if out != ch:
            count[cp] = len(out)
            if len(out) == 1:
                first[cp] = ord(out)
            else:
                first[cp] = len(pool)
                pool += map(ord, out)
        two = unicodedata.decomposition(ch)
        if two and two[0] != "<" and " " in two and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in two.split())
            pairs[a << 21 | b] = cp
    # the scripts of letters that no other script shares, and the other scripts' form of the shared ones
    script, other = np.zeros(size, np.uint8), np.tile(np.arange(size, dtype=np.int32), (4, 1))
    for cp in [*range(0x24F + 1), *range(0x250, 0x530), *range(0x1C80, 0x1C90), *range(0x1E00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA640, 0xA6A0), *range(0xA720, 0xA800)]:
        word = unicodedata.name(chr(cp), "").split(" ")[0]
        if unicodedata.category(chr(cp))[0] == "L":
            script[cp] = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK}.get(word, 0)
    shared = {a: b for a, b in LOOK_ALIKE.items() if b.isalpha() and script[ord(a)] != LATIN}
    for a, b in shared.items():
        other[script[ord(a)], ord(b)] = ord(a)
    letter = script > 0
    for a, b in shared.items():
        script[ord(a)] = script[ord(b)] = 0
    keys = np.array(sorted(pairs), np.int64)
    second = np.zeros(size, bool)
    second[keys & 0x1FFFFF] = True
    return first, count, ccc, np.array(pool or [0], np.int32), keys, np.array([pairs[k] for k in keys.tolist()], np.int32), second, script, letter, other


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array and the offset of each row; nulls count as empty."""
    arr = pc.fill_null(text.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[off - off[0]]


def to_strings(cps: np.ndarray, offsets: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """The inverse of code_points."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF), out=width[1:])
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(width[offsets].tobytes()), pa.py_buffer(data))
    return out if nulls is None or not nulls.null_count else pc.if_else(pc.is_null(nulls), pa.scalar(None, pa.large_string()), out)


def _to_scripts(out: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shared letters, so far all Latin, in the script of their word."""
    _, _, ccc, _, _, _, _, script, letter, other = _tables()
    own = script[out]
    if not (own > LATIN).any():
        return out
    inside = letter[out] | (ccc[out] > 0)
    fresh = inside & ~np.r_[False, inside[:-1] & (row[1:] == row[:-1])]
    word = np.cumsum(fresh) - 1  # the number of the word a letter is in
    votes = np.stack([np.bincount(word[own == k], minlength=int(word[-1]) + 1) for k in (LATIN, CYRILLIC, GREEK)], 1)
    rare = np.bincount(word[np.isin(out, _RARE)], minlength=len(votes)) > 0
    most = np.where(votes.any(1), votes.argmax(1) + 1, np.where(rare, LATIN, 0))
    at = row[np.flatnonzero(fresh)]
    # an undecided word takes the script of the nearest decided one before it in its row, else after it
    n = np.arange(len(most))
    before = np.maximum.accumulate(np.where(most > 0, n, -1))
    after = _next(most)
    use = np.where((before >= 0) & (at[before] == at), before, np.where((after < len(most)) & (at[np.minimum(after, len(most) - 1)] == at), np.minimum(after, len(most) - 1), -1))
    most = np.where(use >= 0, most[use], LATIN)
    return np.where(inside, other[most[np.maximum(word, 0)], out], out)


def _next(most: np.ndarray) -> np.ndarray:
    """The number of the first decided word at or after each; their count where there is none."""
    n = len(most)
    return np.minimum.accumulate(np.where(most > 0, np.arange(n), n)[::-1])[::-1]


def _fold_points(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, count, ccc, pool, keys, made, second = _tables()[:7]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    # a carriage return before a line feed is no character of its own
    cr = cps == 13
    if cr.any():
        drop = np.zeros(len(cps), bool)
        drop[:-1] = cr[:-1] & (cps[1:] == 10) & (row[1:] == row[:-1])
        cps, row = np.where(cr, 10, cps)[~drop], row[~drop]
    n = count[cps].astype(np.int64)
    # a joiner after a sign that kills a vowel changes the print
    join = np.flatnonzero((cps[1:] == 0x200C) | (cps[1:] == 0x200D)) + 1
    join = join[(ccc[cps[join - 1]] == 9) & (row[join] == row[join - 1])]
    n[join] = 1
    if (n == 1).all():
        out = first[cps]
        out[join] = cps[join]
    else:
        start = np.cumsum(n) - n
        src = np.repeat(np.arange(len(cps)), n)
        inner = np.arange(len(src)) - start[src]
        base = first[cps]
        base[join] = cps[join]
        many = n[src] > 1
        out = base[src]
        out[many] = pool[out[many] + inner[many]]
        row = row[src]
    out = _to_scripts(out, row)
    mark = ccc[out]
    if mark.any():
        late = (mark[1:] > 0) & (mark[1:] < mark[:-1]) & (row[1:] == row[:-1])
        if late.any():
            group = np.cumsum((mark == 0) | np.r_[True, row[1:] != row[:-1]])
            order = np.lexsort((mark, group))
            out, row = out[order], row[order]
    while len(out) > 1:
        at = np.flatnonzero(second[out[1:]] & (row[1:] == row[:-1])) + 1
        if not len(at):
            break
        pair = out[at - 1].astype(np.int64) << 21 | out[at]
        k = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[k] == pair
        at, k = at[hit], k[hit]
        # of two overlapping pairs the left one goes first, the other waits for the next pass
        keep = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
        at, k = at[keep], k[keep]
        if not len(at):
            break
        out = out.copy()
        out[at - 1] = made[k]
        live = np.ones(len(out), bool)
        live[at] = False
        out, row = out[live], row[live]
    # blanks before a line end or the end of a text leave no trace in print
    blank = out == 32
    if blank.any():
        solid = np.flatnonzero(~blank)
        at = np.flatnonzero(blank)
        nxt = np.searchsorted(solid, at)
        follows = np.where(nxt < len(solid), solid[np.minimum(nxt, max(len(solid) - 1, 0))] if len(solid) else 0, 0)
        gone = (nxt >= len(solid)) | (row[follows] != row[at]) | (out[follows] == 10)
        live = np.ones(len(out), bool)
        live[at[gone]] = False
        out, row = out[live], row[live]
    new = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(row, minlength=len(offsets) - 1), out=new[1:])
    return out, new


def fold(text: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The consistent form of every row."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if not len(text):
        return pa.array([], pa.large_string())
    done = []
    for part in blocks(text):
        cps, off = code_points(part)
        done.append(to_strings(*_fold_points(cps, off), part))
    return pa.concat_arrays(done)


def blocks(text: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of whole rows of about BLOCK bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(text):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + BLOCK, "right")))
        yield text.slice(lo, hi - lo)
        lo = hi


def fold_str(s: str) -> str:
    return fold(pa.array([s], pa.string()))[0].as_py()


def normalized(df, key: str, text: str, out: str = "folded"):
    """DataFrame (key, text) -> (key, out): one row per input row, null for null."""
    from pyspark.sql import functions as F

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), fold(b.column(1)).cast(pa.string())], [key, out])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` string")


def print_alike_pairs(df, key: str, text: str):
    """Pairs (a, b), a < b, of rows whose texts differ but have one consistent form.

    Rows are hashed first; pairs are built between the distinct texts of one form and only then joined
    to the rows that hold them, so exact copies never meet each other. Null and blank texts are in no
    pair; repeated rows (one key twice) count once.
    """
    from pyspark.sql import functions as F

    base = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    tag = base.select(F.col("k"), F.sha2(F.col("t"), 256).alias("h"), F.col("t"))
    folded = normalized(tag.select(F.struct("k", "h").alias("kh"), "t"), "kh", "t")
    rows = folded.where(F.trim(F.col("folded"), F.lit(" \n")) != "").select(F.col("kh.k").alias("k"), F.col("kh.h").alias("h"), F.sha2("folded", 256).alias("f"))
    return _pairs(rows.dropDuplicates(["k", "h"]))


def _pairs(rows):
    from pyspark.sql import functions as F

    from ..session import durable

    rows = durable(rows)
    kinds = rows.select("f", "h").distinct()
    several = kinds.groupBy("f").count().where("count > 1").select("f")
    kinds = kinds.join(several, "f", "left_semi")
    x, y = kinds.select("f", F.col("h").alias("hx")), kinds.select("f", F.col("h").alias("hy"))
    links = x.join(y, "f").where("hx <> hy").select("hx", "hy")
    a = rows.select(F.col("h").alias("hx"), F.col("k").alias("a"))
    b = rows.select(F.col("h").alias("hy"), F.col("k").alias("b"))
    return links.join(a, "hx").join(b, "hy").where("a < b").select("a", "b")
