"""Sentence boundaries across languages and scripts (problem 7).

A pushdown automaton runs over the events of a text (terminators, quotation marks, brackets, line ends; one compiled pattern
finds them, all other characters are skipped at regex speed). The stack holds the open quotations and
brackets. What a terminator means depends on the stack, on a trie of abbreviations read backwards from the stop, and on what follows:

* a line end closes everything; each line is at least one sentence; a list number at a line start ends nothing;
* inside brackets nothing ends; inside a quotation an end is only noted: when the quotation closes, the noted ends
  count if no clause reports the quotation, else the quotation and its clause are one sentence;
* a stop ends nothing before a small letter, inside numbers and names of files, after initials, titles and
  abbreviations that always go on; terminators of scripts without capitals end whatever follows.

Positions count code points. Null, empty and blank texts have no sentences; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that are followed by a name or a word and so never end a sentence.
GOES_ON = """
mr mrs ms dr prof st lt capt cpt col gen sgt maj rev messrs mt e.g i.e cf viz approx ca vs
hr hrn fr frl frn ing dipl z.b d.h u.a o.ä vgl bzw ggf evtl geb jh
sr sra srta dra ud uds vd vds lic gral aprox ej avda exmo exma
mm mme mmes mlle mgr env c.-à-d
ifj id özv kb pl vö ún ált szt bp szül
проф акад г-н г-жа гр ул просп т.е т.к т.н доц инж тов
डॉ श्री प्रो पं कु सं रु पृ
""".split()
# Abbreviations that end no sentence if a number follows.
BEFORE_NUMBER = "no nos nr n núm vol vols bd p pp s pág págs old fig ch chap sec art abs kap cap hl b c u d д кв стр рис табл гл т п ст".split()
# Abbreviations that may close a sentence before a capital.
MAY_END = "u.k u.s u.s.a e.u u.n d.c b.c a.d n.y ph.d etc stb usw a.m p.m a. m p. inc ltd co corp jr sr u.s.w u.v.m т.д т.п др гг г в н.э".split()
# Words before a German ordinal number, and months and nouns that follow one.
_ORDINAL = "am im vom zum den dem der des das die bis seit ab ende anfang mitte".split()
# Verbs of saying in clauses that start with a name or in scripts without capitals.
_SAYS = re.compile(
    r"\b(?:said|asked|whispered|cried|shouted|replied|answered|muttered|murmured|called|added|exclaimed|sighed|yelled|told|"
    r"mondta|kérdezte|súgta|kiáltotta|felelte|válaszolta|sagte|fragte|flüsterte|rief|antwortete|dit|demanda|murmura|cria|répondit|"
    r"dijo|preguntó|susurró|gritó|respondió|disse|perguntou|sussurrou|gritou|respondeu|сказал\w*|спросил\w*|прошептал\w*|крикнул\w*|ответил\w*)\b"
    r"|कहा|पूछा|बोला|बोली|चिल्ला|फुसफुसा|पुकार|[说說道问問喊叫答嚷讲]|言っ|叫ん|聞い|尋ね|答え|囁い|つぶや"
)

_TERM = ".!?…。！？．｡।॥؟"
_FULL = "。！？｡।॥؟"
_OPEN = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "（": "）", "【": "】", "‘": "’", "‚": "’", '"': '"'}
_CLOSE = set("”»›」』》〉)]）】")
_BRACKET = set("([（【")
_DASH = "–—-−―"
_EVENT = re.compile(r"[.!?…。！？．｡।॥؟]+|[“”„«»‹›「」『』《》〈〉()\[\]（）【】\"]|[\n\r\x0b\x0c\x85  ]+")
_EVENT_SINGLE = re.compile(_EVENT.pattern + r"|[‘’‚]")
_BLANK = re.compile("[\\s​‌‍⁠﻿\xad]*")
_TAIL = re.compile(r"[^\s“„«»‹›「『《(\[（\"”’‘]*\Z")
_TAIL2 = re.compile(r"(?:\b\w{1,2}\. ?)+\w{1,2}\Z")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_ON, _MAY, _NUM = _trie(GOES_ON), _trie(MAY_END), _trie(BEFORE_NUMBER)


def _in_trie(trie: dict, text: str, end: int) -> bool:
    """Whether a word of the trie ends at ``end`` and starts at the start of a word."""
    node, i = trie, end
    while i > 0:
        node2 = node.get(text[i - 1].lower())
        if node2 is None and text[i - 1] == " " and "." in node and text[i - 2 : i - 1] == ".":  # "z. B." is "z.B."
            i -= 1
            continue
        if node2 is None:
            return False
        node = node2
        i -= 1
        if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "._ःािीुूेैोौंँ़्ॉ")):
            return True
    return False


def _skip(text: str, i: int) -> int:
    return _BLANK.match(text, i).end()


def _line_end(text: str, i: int) -> bool:
    return i >= len(text) or text[i] in "\n\r\x0b\x0c\x85  "


def _stop_ends(text: str, a: int, b: int, start: int) -> bool:
    """Whether the terminators text[a:b] can end a sentence, looking at the word before and the character after."""
    mark = text[a]
    if any(c in _FULL for c in text[a:b]):
        return True
    nxt = text[b] if b < len(text) else "\n"
    dots = text[a:b].strip(".") == ""
    ellipsis = mark == "…" or dots and b - a > 1
    if nxt.isalnum():  # no blank follows
        if ellipsis or not nxt.isupper() or a == 0:
            return False
        if mark in "!?":
            return True
        before = _TAIL.search(text, max(start, a - 40), a)[0]
        return len(before) > 2 and before.isalpha() and before[-1].islower() and not _in_trie(_ON, text, a)
    j = _blank_in_line(text, b)
    if _line_end(text, j):
        return True
    c = text[j]
    if c in _DASH:
        if j == b and mark == "." and text[j + 1 : j + 2].isalnum():  # J.-L.
            return False
        k = _blank_in_line(text, j + 1)
        return not (k < len(text) and (text[k].islower() or text[k] in ",;"))
    if c.islower() or c in ",;:":
        return False
    if c.isdigit() and not ellipsis and mark in ".．":
        if _in_trie(_ON, text, a) or _in_trie(_NUM, text, a):
            return False
    if ellipsis:
        return c.isupper() or c.isdigit() or c in _OPEN or c in "¿¡" or c == "�"
    if mark not in ".．" or b - a > 1:
        return True
    if c.isalpha() and not c.isupper():  # scripts without capitals: short words before a stop are abbreviations
        word = _TAIL.search(text, max(start, a - 12), a)[0]
        return len(word) > 4 and not _in_trie(_ON, text, a)
    p = text[a - 1] if a else " "
    if p.isupper() and (a < 2 or not text[a - 2].isalnum()):  # an initial
        if not (a >= 2 and text[a - 2] == "." and _in_trie(_MAY, text, a)):
            return False
    if p.isalpha() and (a < 2 or not text[a - 2].isalnum()) and text[j + 1 : j + 2] == "." and j > b:  # z. B.
        return False
    if _in_trie(_ON, text, a):
        return False
    if p.isdigit():
        word = _TAIL.search(text, max(start, a - 12), a)[0]
        if word.isdigit() and len(word) <= 2:
            lo = a - len(word)
            if text[max(start, 0) : lo].strip() == "":
                return False  # a list number
            prev = _TAIL.search(text, max(start, lo - 12), lo - 1)[0].lower() if lo - 1 > start else ""
            if prev in _ORDINAL:
                return False
    return True


_INLINE = re.compile("[^\\S\n\r\x0b\x0c\x85  ]*")


def _blank_in_line(text: str, i: int) -> int:
    return _INLINE.match(text, i).end()


def _reported_after(text: str, i: int) -> bool:
    """Whether the text after a closed quotation goes on with a clause that reports it."""
    j = _blank_in_line(text, i)
    if _line_end(text, j):
        return False
    c = text[j]
    if c in ",;:，、；" or c.islower():
        return True
    if c in _DASH:
        k = _blank_in_line(text, j + 1)
        return k < len(text) and (text[k].islower() or text[k] in ",;")
    if c in "とっ" and j == i:
        return True
    if c in _OPEN or not c.isalpha():
        return False
    m = re.compile("[^" + _TERM + "“„«「『\"\n]{0,60}").match(text, j)
    clause = m[0]
    if "぀" <= c <= "鿿" and j != i:
        return False
    words = clause.split()
    short = clause[:10] if "぀" <= c <= "鿿" else " ".join(words[: (12 if "ऀ" <= c <= "ॿ" else 4)])
    return bool(_SAYS.search(short)) and (not "぀" <= c <= "鿿" or len(clause) <= 24)


def starts(text: str | None) -> list[int]:
    """The position of the first character of each sentence."""
    if not text:
        return []
    out: list[int] = []
    stack: list[str] = []
    noted: list[int] = []  # ends inside the open quotation of level one
    at = _skip(text, 0)  # the start of the running sentence
    quote_at = seen_to = 0  # words before the open quotation are looked for once, up to seen_to
    told = False
    opens = _OPEN  # what opens a quotation in this text
    n = len(text)
    if at >= n:
        return out
    out.append(at)
    seen_to = at

    def begin(i: int) -> None:
        nonlocal at, seen_to, told
        at = _skip(text, i)
        seen_to, told = at, False
        if at < n:
            out.append(at)

    pattern = _EVENT_SINGLE if "‘" in text or "‚" in text else _EVENT
    for m in pattern.finditer(text):
        a, b = m.span()
        if b <= at and not stack:
            if text[a] not in opens or a < at:
                continue
        c = text[a]
        if c in "\n\r\x0b\x0c\x85  ":
            if stack:
                for e in noted:
                    begin(e)
                stack.clear()
                noted = []
            if a >= at:
                begin(b)
            continue
        if c in _TERM:
            if not stack:
                if _stop_ends(text, a, b, at):
                    e = b
                    while e < n and text[e] in "”»›」』》)]）】" and not (text[e] in "“\""):
                        e += 1
                    begin(e)
            elif len(stack) == 1 and stack[0] not in _BRACKET:
                if _stop_ends(text, a, b, at):
                    noted.append(b)
            continue
        top = stack[-1] if stack else ""
        closes = bool(top) and (c == opens[top] or c == "”" and top in "„“”" or top in "»›" and c in "«‹")
        if c == "’" and not closes:
            continue
        if c == "’" and b < n and text[b].isalnum() and text[b - 2 : b - 1].isalnum():
            continue  # an apostrophe
        if not closes:
            if c in "”»›" and not stack and (b >= n or not text[b].isalnum()):
                continue
            if c in _CLOSE and c not in "”»›":
                continue
            if not stack:
                quote_at, noted = a, []
            if c in opens:
                stack.append(c)
            elif b < n and text[b].isalnum():
                stack.append({"”": "“", "»": "»", "›": "›"}.get(c, "“"))
                opens = {**opens, "»": "«", "›": "‹"}
            continue
        stack.pop()
        if c in ")]）】" and not stack:
            continue
        k = a
        while k > 0 and text[k - 1] in "    ”»」』’)":
            k -= 1
        last = text[k - 1] if k else ""
        ended = last in _TERM and not (last == "." and _in_trie(_ON, text, k - 1))
        if stack:
            if len(stack) == 1 and stack[0] not in _BRACKET and ended and not _reported_after(text, b):
                noted.append(b)
            continue
        if quote_at > seen_to:
            told = told or any(map(str.isalnum, text[seen_to:quote_at]))
            seen_to = quote_at
        reported = told or last in ",，、" or _reported_after(text, b)
        if not reported:
            for e in noted:
                if _skip(text, e) < a and text[_skip(text, e) : a].strip(" \xa0  "):
                    begin(e)
        noted = []
        if ended and not _reported_after(text, b):
            j = _blank_in_line(text, b)
            if not (j < n and text[j] in _TERM):
                begin(b)
    return [p for p, e in zip(out, [*out[1:], n]) if text[p].isalnum() or any(map(str.isalnum, text[p:e]))]


def sentence_starts(df: DataFrame, key: str, text: str) -> DataFrame:
    """DataFrame (key, text) -> (key, start_pos), one row per sentence."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [starts(t) for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            pos = np.fromiter((p for f in found for p in f), np.int32, int(n.sum()))
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos)], [key, "start_pos"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, start_pos int")
