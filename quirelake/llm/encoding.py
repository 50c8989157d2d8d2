"""Garbled text from wrong character encoding (problem 1).

Each suspicious word is the start of a best-first search. States are texts and byte strings; the operations are
*encode* (text to bytes with a code page it may have been read with), *decode* (bytes to text) and *unescape*
(entities and escapes). Visited states are hashed, the queue is ordered by a character-plausibility cost, and
the cheapest reachable text wins if it gains enough over the stored one.

The search ends at the first text taken from the queue that no operation makes cheaper (all others waiting are dearer), or when the queue is empty. It does end: no state may cost more than the stored word by over one nat, undoing UTF-8 and
unescaping shorten the text, and a swap of code pages behind the first step starts from a suspicious state and has to gain what any
swap has to gain. So chains of any length and order of operations are searched; each operation has a price, so that a longer chain
has to explain the word better than a shorter one.

The cost is learned from the corpus itself: counts of characters and of neighbouring characters over all rows of
all fields (a sum over alphabets, so its size is bounded by the alphabets and not by the corpus), with
fixed penalties for control characters, symbols inside words, mixed scripts and capitals after small letters.

Tables are searched by distinct words: rows give their suspicious words, each distinct word is searched once, and the verdicts are joined back
(salted, as one word may stand in a third of all rows).

Words are separated by blanks, line ends and signs that no single-byte page holds (such as East Asian punctuation), not by no-break
spaces, which may be half of a garbled letter. Null and empty texts are sound; a text or word of any length is read whole; repeated
rows get the same answer each. A word that holds a replacement character or a stray control character is garbled but past repair unless
a reading without one is reached.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread

# Code pages a text may have been read with, and encodings it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "mac_roman", "cp437", "cp850", "cp852", "koi8_r", "cp866", "cp1254")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "iso8859-2", "mac_roman", "cp437", "cp850", "cp852", "koi8_r", "cp866", "shift_jis", "euc_jp", "gb18030")
#: Nats a reading has to gain: one that undoes a multi-byte misreading, and one that swaps single-byte code pages.
GAIN_MULTI, GAIN_SINGLE = 4.0, 8.0
#: Nats that another word of a text has to gain from a swap of code pages already established in that text.
GAIN_SAME_TEXT = 1.5
#: Nats each operation of a chain is charged.
PRICE_MULTI, PRICE_SINGLE = 1.0, 8.0
#: Copies of the verdicts in the join with the rows, so that a word of many rows is spread over tasks.
SALT = 16
#: Nats for the choice of one sign within a script that is a single class.
_WITHIN = {0x3040: 3.0, 0x3400: 11.0, 0x4E00: 8.0, 0xAC00: 9.0, 0x20000: 11.0, 0x900: 3.0}
_BYTE_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: The commonest trace of UTF-8 read with a Latin page; a reading that undoes it needs less of a gain.
_LEAD = re.compile("[ÂÃ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_LOOSE = ("cp1252", "cp1250", "cp1251", "cp1254", "latin-1", "iso8859-2")

_WORD = re.compile(r"[^ \t\r\n\f\v\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_EAST, _CYRILLIC = ("shift_jis", "euc_jp", "gb18030"), ("cp1251", "koi8_r", "cp866")
_ODD = re.compile(r"[^\x00-\x7f]|&#?\w{1,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
#: Whole words in scripts that no single-byte misreading yields.
_SAFE = re.compile("[\x21-\x7e぀-ヿ㐀-鿿　-〿＀-￮ऀ-ॿ–—‘’“”…«»]*")
_BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")
#: A sign that no orthography writes between two letters.
_INNER = re.compile("[^\\W\\d_][‹›¢£¤¥¦§¨©«»®¯°±²³µ¶¸¹¿¡„†‡‰€™‚ƒˆ˜¼½¾×÷√≈≤≥∂∑∏π∫Ω◊│-▓]+[^\\W\\d_]")


@lru_cache(1)
def classes() -> np.ndarray:
    """A class for each code point: letters of alphabets stand for themselves, large scripts are one class."""
    out = np.arange(0x110000, dtype=np.int32)
    for lo, hi in ((0x3040, 0x30FF), (0x3400, 0x4DFF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x3FFFF), (0xE000, 0xF8FF), (0x900, 0x97F), (0xF0000, 0x10FFFF)):
        out[lo : hi + 1] = lo
    out[0x30:0x3A] = 0x30
    for c in "\n\r\t\f\v_":
        out[ord(c)] = 32
    out[0x10000:] = 0xFFF0
    return out


def bigram_counts(df: DataFrame, text: str) -> DataFrame:
    """(pair, n): how often each pair of neighbouring character classes stands in the column, over all rows."""
    from .textform import BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, total = classes(), {}
        for b in batches:
            part, size = [], 0
            for t in [*b.iloc[:, 0], None]:
                if t is not None:
                    part.append(t)
                    size += len(t)
                if part and (t is None or size > BLOCK):
                    raw = (" " + " \x00 ".join(part) + " ").encode("utf-32-le", "replace")
                    c = cls[np.frombuffer(raw, np.uint32)].astype(np.int64)
                    keys, n = np.unique(c[:-1] << 21 | c[1:], return_counts=True)
                    for k, v in zip(keys.tolist(), n.tolist()):
                        total[k] = total.get(k, 0) + v
                    part, size = [], 0
        yield pd.DataFrame({"pair": list(total), "n": list(total.values())}, columns=["pair", "n"])

    parts = df.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


class _Steps(dict):
    """Costs of steps, worked out when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: tuple[str, str]) -> float:
        if len(self) > 1_000_000:  # a store for speed only
            self.clear()
        v = self[key] = self.make(*key)
        return v


class Plausibility:
    """Cost in nats of a word under character and bigram counts."""

    def __init__(self, pairs: dict[int, int]):
        self.total = float(sum(pairs.values()) + 1)
        uni: dict[int, int] = {}
        for k, n in pairs.items():
            uni[k & 0x1FFFFF] = uni.get(k & 0x1FFFFF, 0) + n
        self.uni, self.pairs = uni, pairs
        self.steps = _Steps(self._step)

    def step(self, a: str, b: str) -> float:
        return self.steps[a, b]

    def _step(self, a: str, b: str) -> float:
        cls = classes()
        ca, cb = int(cls[ord(a)]), int(cls[ord(b)])
        base = (self.uni.get(cb, 0) + 0.05) / self.total
        near = (self.pairs.get(ca << 21 | cb, 0) + 20 * base) / (self.uni.get(ca, 0) + 20)
        cost = -0.5 * math.log(near) - 0.5 * math.log(base) + _WITHIN.get(cb, 0.0)
        kb, ka = unicodedata.category(b), unicodedata.category(a)
        if b == "�" or kb in ("Cn", "Co", "Cs") or kb == "Cc" and b not in "\n\t\r\f\v":
            cost += 8
        elif kb == "Mn" and ka[0] not in "LM":
            cost += 6
        elif kb in ("So", "Sm", "Sk", "Sc", "No") and ka[0] == "L" or ka in ("So", "Sm", "Sk", "Sc", "No") and kb[0] == "L":
            cost += 2
        elif ka[0] == "L" and kb[0] == "L":
            if _script(a) != _script(b):
                cost += 3
            elif ka == "Ll" and kb == "Lu":
                cost += 2
        if ka == kb == "Lu" and a.lower() != a and len(a.lower()) == len(b.lower()) == 1:  # words in capitals
            cost = min(cost, self._step(a.lower(), b.lower()) + 0.7)
        return cost

    def cost(self, word: str) -> float:
        return sum(map(self.steps.__getitem__, zip(" " + word, word + " ")))


@lru_cache(4096)
def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFF21 <= cp <= 0xFF5A:
        return "LATIN"
    name = unicodedata.name(ch, "?").split(" ")[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") or cp >= 0x3000 else name


class _Page(dict):
    """The byte of each character on a code page, as str.translate wants it; NUL for characters the page lacks."""

    def __init__(self, name: str):
        self.name, self.cyrillic = name, name in _CYRILLIC

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        try:
            b = c.encode(self.name)
        except UnicodeEncodeError:  # bytes a page leaves undefined often pass as control characters
            b = bytes([cp]) if 0x80 <= cp < 0xA0 and self.name in _LOOSE else b"\0"
        v = self[cp] = chr(b[0])
        return v


_PAGES = [_Page(p) for p in READ_AS]


def _undo_runs(text: str, data: bytes, cyrillic: bool) -> str | None:
    """The text with every run of characters whose bytes are UTF-8 put right, the rest kept."""
    out, at = [], 0
    for m in _BYTE_RUN.finditer(data):
        try:
            good = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not good.strip() and cyrillic:  # a letter before a no-break space
            continue
        out += [text[at : m.start()], good]
        at = m.end()
    return "".join([*out, text[at:]]) if out else None


def _unescape(text: str) -> list[str]:
    out = []
    if "&" in text and ";" in text:
        out.append(html.unescape(text))
    if "\\u" in text or "\\x" in text:
        out.append(re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), text))
    return [x for x in out if x != text and not any(0xD800 <= ord(c) < 0xE000 for c in x)]


def _readings(text: str, swaps: bool) -> Iterator[tuple[str, bool, tuple[str, str] | None]]:
    """(text, whether UTF-8 or an escape was undone, the pair of pages if they were swapped) of all operations on a text."""
    for x in _unescape(text):
        yield x, True, None
    tried: set[tuple[bytes, bool]] = set()
    for page in _PAGES:
        data = text.translate(page).encode("latin-1")
        if (data, page.cyrillic) in tried or data.isascii():
            continue
        tried.add((data, page.cyrillic))
        if (x := _undo_runs(text, data, page.cyrillic)) is not None:
            yield x, True, None
        if not swaps or b"\0" in data:
            continue
        for made in WRITTEN_IN:
            if made in _EAST and page.cyrillic:
                continue
            try:
                yield data.decode(made), made == "utf-8", (page.name, made)
            except UnicodeDecodeError:
                continue


def search(word: str, start: float, model: Plausibility, established: tuple[str, str] | None = None) -> tuple[str, float, tuple[str, str] | None]:
    """(best text, gain, the pair of code pages if only those were swapped) of the cheapest reachable text.

    A reading that undoes UTF-8 goes before one that swaps single-byte pages, which has to gain more, unless it swaps
    the pages that are ``established`` for the text the word stands in.
    """
    queue: list[tuple[float, int, str, bool, float, float]] = [(start, 0, word, False, start, 0.0)]
    seen: set[int] = {hash(word)}
    one, many, same, n = (0.0, word, None), (0.0, word), (0.0, word), 0
    best_one = best_many = -1e9
    while queue:
        _, _, state, multi, cost, paid = heapq.heappop(queue)
        first = state == word
        swaps = first or bool(_BROKEN.search(state)) or _suspicious(state, model)
        goal = multi  # one that only swapped pages does not end it, as undoing UTF-8 goes before
        for x, undone, pages in _readings(state, swaps):
            if (h := hash(x)) in seen:
                continue
            seen.add(h)
            c = model.cost(x)
            if c >= start + 1 or not undone and not first and c > cost - GAIN_SINGLE:
                continue
            gain, price = start - c, paid + (PRICE_MULTI if undone else PRICE_SINGLE)
            if undone or multi:
                if gain - price > best_many:
                    best_many, many = gain - price, (gain, x)
            else:
                if gain - price > best_one:
                    best_one, one = gain - price, (gain, x, pages if first else None)
                if first and pages == established:
                    same = max(same, (gain, x))
            n += 1
            goal = goal and c + price >= cost + paid
            heapq.heappush(queue, (c + price, n, x, undone or multi, c, price))
        if goal:
            break
    if many[0] >= (GAIN_MULTI / 2 if _LEAD.search(word) else GAIN_MULTI) and (many[0] >= one[0] - 6 or many[0] >= 0.5 * one[0]):
        return many[1], many[0], None
    if established and same[0] >= GAIN_SAME_TEXT:
        return same[1], same[0], established
    return (one[1], one[0], one[2]) if one[0] >= (GAIN_MULTI if _BROKEN.search(word) or _INNER.search(word) else GAIN_SINGLE) else (word, 0.0, None)


def _starts(words: list[str], model: Plausibility) -> list[float]:
    """The cost of each word as stored, or of its consistent form where that reads better (another problem's damage)."""
    import pyarrow as pa

    from .textform import fold

    cost = [model.cost(w) for w in words]
    odd = [i for i, w in enumerate(words) if any(map(_foldable, w))]
    for i, made in zip(odd, fold(pa.array([words[i] for i in odd], pa.string())).to_pylist()):
        if made != words[i]:
            cost[i] = min(cost[i], model.cost(made))
    return cost


@lru_cache(20_000)
def _foldable(ch: str) -> bool:
    from .textform import LOOK_ALIKE

    return ch > "\x7f" and (unicodedata.category(ch) in ("Cf", "Zs", "Mn") or ch in LOOK_ALIKE or unicodedata.decomposition(ch)[:1] == "<")


Verdict = tuple[str, tuple[str, str] | None]


def to_search(word: str, model: Plausibility) -> bool:
    """Whether a word is searched at all: it is broken, or its steps are dear enough."""
    if word.isascii():
        return bool(_ODD.search(word) or _BROKEN.search(word))
    return bool(_BROKEN.search(word)) or not _SAFE.fullmatch(word) and _suspicious(word, model)


def judge(words: list[str], model: Plausibility, established: tuple[str, str] | None = None) -> list[Verdict | None]:
    """(repaired word, swapped pages) of each word, the word itself where it is broken past repair, or None for a sound one."""
    out: list[Verdict | None] = []
    for w, start in zip(words, _starts(words, model)):
        best, gain, swap = search(w, start, model, established)
        out.append((best, swap) if gain > 0 else (w, None) if _BROKEN.search(w) else None)
    return out


def _suspicious(word: str, model: Plausibility) -> bool:
    """Whether the steps of the word are dear enough for a search to be able to gain what a reading has to gain."""
    a, worst, over = " ", 0.0, 0.0
    for b in word:
        if b > "\x7f" or a > "\x7f":
            c = model.step(a, b)
            worst = max(worst, c)
            over += max(0.0, c - 4.5)
        a = b
    return bool(_LEAD.search(word)) or worst > 7.5 and over > GAIN_MULTI or word.isascii() and bool(_ODD.search(word))


def odd_words(text: str | None) -> set[str]:
    """The words of a text that a wrong encoding may have touched."""
    if not text or text.isascii() and not ("&" in text or "\\" in text):
        return set()
    return {w for w in _WORD.findall(text) if not w.isascii() or _ODD.search(w)}


def rewrite(text: str, found: dict[str, Verdict], model: Plausibility) -> tuple[str, int, int]:
    """(repaired text, garbled words, words past repair) with the verdicts on the words of a text.

    Pages that were swapped for one word are established for its neighbours, which are searched again with a lower threshold.
    """
    swaps = Counter(v[1] for v in found.values() if v[1])
    if swaps:
        pages = max(swaps, key=lambda k: (swaps[k], k))
        rest = sorted(w for w in odd_words(text) - found.keys() if not w.isascii())
        found = found | {w: v for w, v in zip(rest, judge(rest, model, pages)) if v and v[1] == pages}
    bad = lost = 0

    def each(m: re.Match) -> str:
        nonlocal bad, lost
        got = found.get(m[0])
        if got is None:
            return m[0]
        bad += 1
        lost += bool(_BROKEN.search(got[0]))
        return got[0]

    return _WORD.sub(each, text), bad, lost


def prepare(texts: Iterable[str | None], model: Plausibility, memo: dict) -> None:
    """Puts the verdicts on all words of several texts into the memo at once."""
    new = sorted(set().union(*map(odd_words, texts)) - memo.keys())
    memo.update(dict.fromkeys(new))
    ask = [w for w in new if to_search(w, model)]
    memo.update(zip(ask, judge(ask, model)))


def repair(text: str | None, model: Plausibility, memo: dict) -> tuple[str | None, int, int]:
    """(repaired text, garbled words, words past repair) of one text; ``memo`` keeps verdicts between texts."""
    odd = [w for w in odd_words(text) if w not in memo]
    if len(memo) > 200_000:
        memo.clear()
        odd = list(odd_words(text))
    memo.update(dict.fromkeys(odd))
    ask = [w for w in odd if to_search(w, model)]
    memo.update(zip(ask, judge(ask, model)))
    found = {w: v for w in odd_words(text) if (v := memo[w])}
    return rewrite(text, found, model) if found else (text, 0, 0)


def learn(*fields: tuple[DataFrame, str]) -> Plausibility:
    """The plausibility model of all rows of the given (table, column) pairs."""
    counts = None
    for df, col in fields:
        c = bigram_counts(df, col)
        counts = c if counts is None else counts.unionByName(c)
    pairs = {r["pair"]: r["n"] for r in counts.groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator()}
    return Plausibility(pairs)


def _map(df: DataFrame, model: Plausibility, each: Callable, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model.pairs)
    names = [x.split(" ")[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Plausibility(shared.value)
        for b in batches:
            yield pd.DataFrame(list(each(b, own)), columns=names)

    return df.mapInPandas(run, schema)


def verdicts(df: DataFrame, keys: list[str], text: str, model: Plausibility) -> DataFrame:
    """(keys, word, better, page, made) of the garbled words of each row; every distinct word is searched once."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def pick(b: pd.DataFrame, own: Plausibility) -> Iterator[tuple]:
        sound: set[str] = set()
        for row in b.itertuples(index=False, name=None):
            for w in odd_words(row[-1]) - sound:
                if to_search(w, own):
                    yield (*row[:-1], w)
                else:
                    sound.add(w)

    def ask(b: pd.DataFrame, own: Plausibility) -> Iterator[tuple]:
        words = b["word"].tolist()
        return ((w, v[0], *(v[1] or (None, None))) for w, v in zip(words, judge(words, own)) if v)

    hits = durable(_map(df.select(*keys, text), model, pick, f"{kinds}, word string"))
    known = durable(_map(spread(hits.select("word").distinct(), "word"), model, ask, "word string, better string, page string, made string"))
    salted = known.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return hits.withColumn("s", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")).join(salted, ["word", "s"]).select(*keys, "word", "better", "page", "made")


def garbled(df: DataFrame, keys: list[str], text: str, model: Plausibility) -> DataFrame:
    """(keys) of the rows that hold a garbled word, once each."""
    return verdicts(df, keys, text, model).select(*keys).distinct()


def repaired(df: DataFrame, keys: list[str], text: str, model: Plausibility) -> DataFrame:
    """(keys, garbled_words, lost_words, repaired) of the rows that hold a garbled word."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    fixes = verdicts(df, keys, text, model).groupBy(*keys).agg(F.collect_set(F.array("word", "better", "page", "made")).alias("fixes"))

    def run(b: pd.DataFrame, own: Plausibility) -> Iterator[tuple]:
        for row in b.itertuples(index=False, name=None):
            found = {x[0]: (x[1], (x[2], x[3]) if x[2] else None) for x in row[-1]}
            new, bad, lost = rewrite(row[-2], found, own)
            yield (*row[:-2], bad, lost, new)

    joined = df.select(*keys, text).join(fixes, keys).select(*keys, text, "fixes")
    return _map(joined, model, run, f"{kinds}, garbled_words int, lost_words int, repaired string")
