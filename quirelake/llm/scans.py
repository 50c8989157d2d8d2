"""Noise in text from scanned pages (problem 6).

Four kinds of trace are found and undone: words cut at line ends, page numbers and running headers between
lines, stray marks, and misread characters.

Misreadings: the lexicon of all words of the corpus with their frequency is put into a symmetric-delete index (forms with confusable
digraphs unified, each with one character deleted; the index holds their hashes, so words of any length are filed); words that meet there
are compared by an edit distance in which confusion pairs are cheap and all else is dear. A word is a misreading of a much more
frequent word at a small distance; which of several it is, and whether it is one at all, is decided at each place by the words beside it (bigram
counts of the corpus), then by frequency.

All counts cover all rows. Three passes read the texts: one for the lexicon and the traces of the page, one for the places of words that
have corrections, one for the bigrams asked for. The passes know the words they look for from bitmaps of a fixed size; what a bitmap lets
through by chance, a join takes out. Lexicon, index and corrections stay distributed. Null and empty texts are clean; repeated
rows get equal answers; clean text that is only wrapped into lines is no case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread
from .index import deletes

# What a scanner takes for what; digraphs first, then single characters.
DIGRAPHS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("VV", "W"))
CONFUSED = {frozenset(p) for p in ("ce", "1l", "1i", "1I", "lI", "bh", "ft", "6é", "6ó", "6b", "5s", "5S", "0o", "0O", "8B", "ни", "пн", "3з", "6б")}
#: A misreading is at least so many times rarer than the word it stands for, which occurs at least so often.
RATIO, LEAST = 10, 5
#: Cost of a confusion and of any other edit, and the most a repair may cost.
CHEAP, DEAR, MOST = 0.4, 2.0, 0.9

#: Bits of a bitmap of words.
BITS = 1 << 24

_INVISIBLE = re.compile("[​‌‍⁠﻿]|\xad(?! *\n)")
_CUT_HERE = re.compile(r"[-‐¬\xad] *\n")
_MAY_BE_LINE = re.compile(r"\d|^[ \t]*[—–-]")
_MARKS = re.compile("[|~^·•¦]")
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"([^\W\d_]+)([-‐¬\xad]) *\n[ \n]*([^\W\d_]+)")
_NUMBER_LINE = re.compile(r"^[ \t]*(?:[\[(|<~·•*—–-]+[ \t]*)?(?:p\.|page|pag\.|s\.|стр\.)?[ \t]*\d{1,4}[ \t]*(?:[\])|>~·•*—–-]+)?[ \t]*$|^[ \t]*[—–-]{1,2}[ \t]*[ivxlc]{1,6}[ \t]*[—–-]{1,2}[ \t]*$", re.I)
_HEADER_LINE = re.compile(r"^\f?[ \t]*(?:\d{1,4}(?:[ \t]{2,}|[ \t]*[|·•—–][ \t]*)\S.{2,70}|\S.{2,70}?(?:[ \t]{2,}|[ \t]*[|·•—–][ \t]*)\d{1,4})[ \t]*$")
_STRAY = re.compile(r"(?:(?<=[^\W_])|(?<=[^\W_][,.;:!?])|(?<=\s)(?<!\n))[ \t]*[|~^·•¦]+(?=[ \t]|\n|$)")
_STRAY_START = re.compile(r"(?m)(?<=[^\n]\n)[|~^·¦]+ +(?=[^\W_])")
_GARBLED = re.compile("[ÐÑĐŃÃÂâĹĂ├┬╨╤]")  # marks beside these come from a wrong encoding, not from a page
_ENDS = ".!?…。！？»”\"“’)」:;।"


def lines_to_drop(lines: list[str]) -> set[int]:
    """Numbers of the lines that are page numbers, running headers or footers."""
    drop: set[int] = set()
    solid = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(solid):
        line, bare = lines[i], lines[i].strip("\f \t")
        fresh = line.startswith("\f")
        if not fresh and not _MAY_BE_LINE.search(line):
            continue
        header = _HEADER_LINE.match(bare)
        if not (fresh or header or _NUMBER_LINE.match(bare)):
            continue
        prev = lines[solid[k - 1]].strip() if k else ""
        nxt = lines[solid[k + 1]].strip() if k + 1 < len(solid) else ""
        if prev or nxt:
            inside = bool(nxt) and (nxt[:1].islower() or prev[-1:] not in _ENDS)
            if fresh or header or inside or re.search(r"\W", bare) or len(bare) >= 2:
                drop.add(i)
    for i in sorted(drop):  # a header that stands beside its page number
        for j in (i + 1, i - 1):
            if 0 <= j < len(lines) and j not in drop and _NUMBER_LINE.match(lines[i].strip("\f \t")):
                s = lines[j].strip("\f \t")
                words = s.split()
                if s and s[-1] not in _ENDS + "," and len(words) <= 9 and sum(w[:1].isupper() for w in words) * 2 > len(words) and not s[0].islower():
                    near = lines[j + 1] if j > i and j + 1 < len(lines) else lines[j - 1] if j < i and j else ""
                    if not near.strip() or near.strip()[0].islower() or j == len(lines) - 1 or len(words) > 1:
                        drop.add(j)
    return drop


def clean(text: str) -> str:
    """The text without signs that do not print; places in a text count on this form."""
    return _INVISIBLE.sub("", text)


def signs(text: str) -> tuple[int, int, list[tuple[str, str, str, str]]]:
    """(page lines, stray marks, cut words as (joined, left, mark, right)) of one clean text."""
    marks = _MARKS.search(text)
    if "\n" not in text and not marks:
        return 0, 0, []
    drop: set[int] = set()
    body = text
    if "\n" in text:
        lines = text.split("\n")
        drop = lines_to_drop(lines)
        if drop:
            body = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    cuts = [(m[1] + m[3], m[1], m[2], m[3]) for m in _CUT.finditer(body)] if _CUT_HERE.search(body) else []
    if not marks:
        return len(drop), 0, cuts
    stray = sum(not _GARBLED.search(body[max(0, m.start() - 8) : m.start()]) for m in _STRAY.finditer(body))
    return len(drop), stray + len(_STRAY_START.findall(body)), cuts


def words_of(text: str) -> str:
    """A clean text in which words cut at line ends are blanked out."""
    return _CUT.sub(lambda m: " " * len(m[0]), text) if _CUT_HERE.search(text) else text


def read(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexicon (word, n), (key, page_lines, stray, sure_cuts, cuts), the table both are kept in) in one pass over the texts."""
    kind = df.schema[key].dataType.simpleString()
    cols = [key, "page_lines", "stray", "sure_cuts", "cuts", "word", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def words() -> pd.DataFrame:  # counted in each worker before the shuffle
            return pd.DataFrame([(None, None, None, None, None, w, n) for w, n in total.items()], columns=cols).astype({c: "Int64" for c in cols[1:4]} | ({key: "Int64"} if kind in ("bigint", "int") else {}))

        for b in batches:
            rows = []
            for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if not t:
                    continue
                t = clean(t)
                total.update(_WORD.findall(words_of(t)))
                pages, stray, cuts = signs(t)
                if pages or stray or cuts:
                    rows.append((k, pages, stray, sum(m in "¬\xad" for _, _, m, _ in cuts), [[j, x, y] for j, x, m, y in cuts if m not in "¬\xad"], None, None))
            yield pd.DataFrame(rows, columns=cols).astype({"n": "Int64"})
            if len(total) > 300_000:
                yield words()
                total.clear()
        if total:
            yield words()

    kept = durable(df.select(key, text).mapInPandas(run, f"`{key}` {kind}, page_lines int, stray int, sure_cuts int, cuts array<array<string>>, word string, n long"))
    lex = kept.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    return lex, kept.where("word is null").drop("word", "n"), kept


def canonical(word: str) -> str:
    for a, b in DIGRAPHS:
        word = word.replace(a, b)
    return word


def distance(a: str, b: str, most: float = MOST) -> float:
    """Weighted edit distance: confusion pairs and digraphs are cheap. Within ``most`` no more than two edits fit, so a band of five suffices."""
    inf = most + 9
    la, lb = len(a), len(b)
    if abs(la - lb) > 2:
        return inf
    rows: list[dict[int, float]] = [{} for _ in range(la + 1)]
    rows[0][0] = 0.0
    for i in range(la + 1):
        for j in range(max(0, i - 2), min(lb, i + 2) + 1):
            v = rows[i].get(j, inf)
            if v > most:
                continue
            if i < la and j < lb:
                c = 0.0 if a[i] == b[j] else CHEAP if frozenset((a[i], b[j])) in CONFUSED else DEAR
                if v + c < rows[i + 1].get(j + 1, inf):
                    rows[i + 1][j + 1] = v + c
            for x, y in DIGRAPHS:
                for p, q in ((x, y), (y, x)):
                    if a.startswith(p, i) and b.startswith(q, j) and v + CHEAP < rows[i + len(p)].get(j + len(q), inf):
                        rows[i + len(p)][j + len(q)] = v + CHEAP
    return rows[la].get(lb, inf)


def corrections(lex: DataFrame) -> DataFrame:
    """(word, n, better, m, cost): every word that may be a misreading, with each word it may stand for.

    A key holds a frequency band besides the hash: a word meets only words of a higher band, so words of one rank never
    meet, and what meets under a short key is bounded by the alphabets.
    """

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, k) for w, n in zip(b["word"], b["n"]) if not w.isdigit() for k in deletes(canonical(w))]
            yield pd.DataFrame(rows, columns=["word", "n", "k"])

    keyed = spread(lex.where(F.length("word") >= 3), "word").mapInPandas(file, "word string, n long, k string")
    keyed = durable(keyed.select("word", "n", F.xxhash64("k").alias("h"), F.length(F.col("n").cast("string")).alias("band")))
    right = keyed.where((F.col("n") >= LEAST) & (F.col("band") > 1)).select(F.col("word").alias("better"), F.col("n").alias("m"), "h", F.explode(F.sequence(F.lit(1), F.col("band") - 1)).alias("band"))
    pairs = keyed.join(right, ["h", "band"]).where(F.col("m") >= F.col("n") * RATIO).where("word <> better").select("word", "n", "better", "m").distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["cost"] = [distance(x, y) for x, y in zip(b["word"], b["better"])]
            yield b[b["cost"] <= MOST]

    return pairs.mapInPandas(weigh, "word string, n long, better string, m long, cost double")


def bitmap(words: DataFrame, col: str) -> np.ndarray:
    """A bitmap of the checksums of the words of a column; its size is fixed, whatever the number of words."""
    bit = words.select(F.pmod(F.crc32(col), F.lit(BITS)).alias("b")).distinct()
    slots = bit.groupBy(F.shiftright("b", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("bits"))
    out = np.zeros(BITS >> 6, np.uint64)
    for r in slots.toLocalIterator():
        out[r.slot] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return out


class _Flags(dict):
    """Which of several bitmaps hold a word, as a bit set."""

    def __init__(self, maps: list[np.ndarray]):
        self.maps = maps

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:  # a store for speed only
            self.clear()
        b = zlib.crc32(word.encode("utf-8", "replace")) % BITS
        v = self[word] = sum(int(m[b >> 6]) >> (b & 63) & 1 and 1 << i for i, m in enumerate(self.maps))
        return v


def places(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """(key, pos, word, before, after) of every place of a word that has corrections; ``pos`` counts in the clean text."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bitmap(fixes, "word"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = _Flags([shared.value])
        for b in batches:
            rows = []
            for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if t:
                    body = words_of(clean(t))
                    ws = ["", *_WORD.findall(body), ""]
                    hit = [i for i, w in enumerate(ws) if len(w) >= 3 and flags[w]]
                    if hit:
                        at = [m.start() for m in _WORD.finditer(body)]
                        rows += [(k, at[i - 1], ws[i], ws[i - 1], ws[i + 1]) for i in hit]
            yield pd.DataFrame(rows, columns=[key, "pos", "word", "before", "after"])

    seen = df.select(key, text).mapInPandas(run, f"`{key}` {kind}, pos int, word string, before string, after string")
    return seen.join(fixes.select("word").distinct(), "word", "left_semi")


def misread(df: DataFrame, key: str, text: str, lex: DataFrame) -> DataFrame:
    """(key, pos, word, better): the misread words at each place of each text, and the repair that context and frequency pick there.

    A place whose own neighbours tell nothing takes the repair that the other places of the word in its text support most.
    """
    fixes = durable(corrections(lex))
    seen = durable(places(df, key, text, fixes))
    asked = seen.select("word", "before", "after").distinct().join(fixes, "word")
    # bigrams of the candidates with the words that stand beside the misreading, counted over the corpus
    want = asked.select(F.col("before").alias("x"), F.col("better").alias("y")).unionByName(asked.select(F.col("better").alias("x"), F.col("after").alias("y")))
    have = _bigrams(df, text, durable(want.where("x <> '' and y <> ''").distinct()))
    left, right = have.toDF("before", "better", "nl"), have.toDF("better", "after", "nr")
    scored = asked.join(left, ["before", "better"], "left").join(right, ["better", "after"], "left")
    scored = scored.withColumn("context", F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0)))
    # without support from its neighbours a word must be a far rarer one than its correction
    scored = scored.where((F.col("context") > 0) | (F.col("m") >= F.col("n") * 10 * RATIO))
    best = scored.groupBy("word", "before", "after").agg(F.max(F.struct("context", (-F.col("cost")).alias("c"), "m", "better")).alias("b"))
    best = best.select("word", "before", "after", F.col("b.better").alias("own"), F.col("b.context").alias("context"))
    judged = durable(seen.join(best, ["word", "before", "after"], "left"))
    votes = judged.where("own is not null").groupBy(key, "word", "own").agg(F.sum("context").alias("c"))
    near = votes.groupBy(key, "word").agg(F.max_by("own", F.struct("c", "own")).alias("near"))
    return judged.join(near, [key, "word"]).select(key, "pos", "word", F.coalesce("own", "near").alias("better"))


def _bigrams(df: DataFrame, text: str, want: DataFrame) -> DataFrame:
    """Counts of the wanted bigrams over all rows."""
    shared = df.sparkSession.sparkContext.broadcast([bitmap(want, "x"), bitmap(want, "y")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, total = _Flags(shared.value), Counter()
        for b in batches:
            for t in b.iloc[:, 0]:
                if t:
                    ws = _WORD.findall(words_of(clean(t)))
                    f = [flags[w] for w in ws]
                    total.update((ws[i], ws[i + 1]) for i in range(len(ws) - 1) if f[i] & 1 and f[i + 1] & 2)
            if len(total) > 200_000:
                yield pd.DataFrame([(x, y, n) for (x, y), n in total.items()], columns=["x", "y", "n"])
                total.clear()
        yield pd.DataFrame([(x, y, n) for (x, y), n in total.items()], columns=["x", "y", "n"])

    counted = df.select(text).mapInPandas(run, "x string, y string, n long")
    return counted.join(want, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.sum("n").alias("n"))


def whole_words(found: DataFrame, key: str, lex: DataFrame) -> DataFrame:
    """(key, joined): cut words whose joined form the lexicon confirms."""
    cut = found.select(key, F.explode("cuts").alias("c")).select(key, F.col("c")[0].alias("word"), F.col("c")[1].alias("x"), F.col("c")[2].alias("y"))
    n = lex.select(F.col("word"), F.col("n").alias("nj"))
    cut = cut.join(n, "word", "left").join(lex.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y", "left").join(lex.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x", "left")
    # a compound keeps its hyphen: both parts are words and the joined form is not
    whole = cut.where((F.coalesce("nj", F.lit(0)) > 0) | (F.least(F.coalesce("nx", F.lit(0)), F.coalesce("ny", F.lit(0))) == 0) & (F.substring("y", 1, 1) == F.lower(F.substring("y", 1, 1))))
    return whole.select(key, F.col("word").alias("joined"))


def damaged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_lines, stray, cut_words, misread): the texts that carry traces of a scanned page."""
    df = df.select(key, text).where(F.col(text).isNotNull())
    lex, marks, _ = read(df, key, text)
    lex = durable(lex)
    cuts, bad = whole_words(marks, key, lex), misread(df, key, text, lex)
    parts = [
        marks.select(key, "page_lines", "stray", F.col("sure_cuts").alias("cut_words"), F.lit(0).alias("misread")),
        cuts.select(key, F.lit(0).alias("page_lines"), F.lit(0).alias("stray"), F.lit(1).alias("cut_words"), F.lit(0).alias("misread")),
        bad.select(key, F.lit(0).alias("page_lines"), F.lit(0).alias("stray"), F.lit(0).alias("cut_words"), F.lit(1).alias("misread")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["page_lines", "stray", "cut_words", "misread"]
    out = out.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])
    return out.where(" + ".join(names) + " > 0")


def mend(text: str, fixes: dict[int, tuple[str, str]], cuts: set[str]) -> str:
    """The text without traces of the page, as continuous paragraphs; ``fixes`` has (word, better) by place in the clean text."""
    text = clean(text)
    parts, at = [], 0
    for pos in sorted(fixes):
        word, better = fixes[pos]
        parts += [text[at:pos], better]
        at = pos + len(word)
    text = "".join([*parts, text[at:]])
    lines = text.split("\n")
    drop = lines_to_drop(lines)
    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    text = _CUT.sub(lambda m: m[1] + m[3] if m[2] in "¬\xad" or m[1] + m[3] in cuts else m[1] + m[2] + m[3], text)
    text = _STRAY_START.sub("", _STRAY.sub("", text))
    text = re.sub(r"(?<=[^\n]) *\n(?=[^\n])", " ", text.replace("\f", "\n"))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def mended(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mended): the repaired text of every text that carries traces of a scanned page."""
    kind = df.schema[key].dataType.simpleString()
    base = df.select(key, text).where(F.col(text).isNotNull())
    lex, marks, _ = read(base, key, text)
    lex = durable(lex)
    bad = misread(base, key, text, lex).groupBy(key).agg(F.collect_set(F.struct("pos", "word", "better")).alias("fixes"))
    cuts = whole_words(marks, key, lex).groupBy(key).agg(F.collect_set("joined").alias("cuts"))
    hit = marks.where("page_lines + stray + sure_cuts > 0").select(key).unionByName(cuts.select(key)).unionByName(bad.select(key)).distinct()
    joined = base.join(hit, key, "left_semi").join(bad, key, "left").join(cuts, key, "left").select(key, text, "fixes", "cuts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, mend(t, {x["pos"]: (x["word"], x["better"]) for x in f} if f is not None else {}, set(c) if c is not None else set()))
                for k, t, f, c in zip(b.iloc[:, 0], b.iloc[:, 1], b["fixes"], b["cuts"])
            ]
            yield pd.DataFrame(rows, columns=[key, "mended"])

    return joined.mapInPandas(run, f"`{key}` {kind}, mended string")
