"""Subject areas of documents (problem 10).

One interpolated n-gram model (bigram, unigram, uniform) for each subject and language, and a background model for each
language over all documents and test items. A sentence's score for a subject is the mean over its tokens of how
many nats the subject's model saves against the background. A sentence is on the subject that saves most, if
that is more than the threshold calibrated for that subject; a document has each subject that enough of its sentences are on.

Labels name documents, not sentences, and are noisy, so the models are fitted in rounds: each sentence of a labelled
document counts for that of the document's labels that saves most under the last round's models, or for none.
Passages in the manner of held-out test items belong to no subject: their text trains a model of its own that competes.

Words and word pairs are numbers; a block of texts is counted and scored by array operations.

The fit reads at most about ``max_docs`` labelled documents, whole (the documented bound of the sample, chosen by hash over all
labels); everything else covers all rows and whole texts. The background is counted over all documents in a distributed aggregation,
and only its totals and the words and pairs that the sample or the items hold come to the driver. Null and blank documents have no
subject; repeated labels count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release, spread
from .sentences import starts

_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_SOFT = re.compile(r"(?<=[^\n])[ \t]*\r?\n(?=[ \t]*[^\s])")
NONE = "-"
#: Words of the background that a subject's count is interpolated with, and counts under which a word or pair tells nothing.
STRENGTH, LEAST_WORD, LEAST_PAIR = 3.0, 2, 3
#: Thresholds that are tried, in nats a token.
GRID = (0.0, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3)
#: Characters of texts that are scored at once; a longer text is a block of its own.
BLOCK = 500_000


def split(text: str | None) -> list[str]:
    text = _SOFT.sub(" ", text) if text else ""  # a line wrapped inside a paragraph goes on
    at = starts(text)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])] if at else []


def sentence_words(text: str | None) -> list[list[str]]:
    return [ws for s in split(text) if (ws := _TOKEN.findall(s))]


class _Numbers(dict):
    """The number of a word as written; -1 for one that is not known."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:  # a store for speed only
            self.clear()
        v = self[word] = self.index.get(word.lower(), -1)
        return v


class Encoded:
    """Texts as numbers: words, the sentence of each word, the text of each sentence, the pair each word closes."""

    def __init__(self, texts: Iterable[list[list[str]]], numbers: _Numbers):
        tok: list[int] = []
        size, of, unknown = [], [], []
        for n, ss in enumerate(texts):
            miss: list[str] = []
            for ws in ss:
                ids = list(map(numbers.__getitem__, ws))
                if min(ids) < 0:
                    miss += [w.lower() for w, i in zip(ws, ids) if i < 0]
                tok += ids
                size.append(len(ids))
                of.append(n)
            unknown.append(miss)
        self.tok, self.size, self.of, self.unknown = np.array(tok, np.int64), np.array(size, np.int64), np.array(of, np.int64), unknown
        self.at = np.cumsum(self.size) - self.size
        self.sentence = np.repeat(np.arange(len(size)), self.size)

    def languages(self, share: np.ndarray, texts: int) -> np.ndarray:
        """The language of each text: the one its words are most of; -1 without known words."""
        lang = np.full(texts, -1)
        if len(self.tok) and share.shape[1]:
            got = np.where((self.tok >= 0)[:, None], share[np.maximum(self.tok, 0)], 0.0)
            first = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
            sums = np.add.reduceat(got, self.at[first], axis=0)
            best = share.shape[1] - 1 - sums[:, ::-1].argmax(1)
            lang[self.of[first]] = np.where(sums.any(1), best, 0)
        return lang


class Models:
    """Everything that scoring needs: words, languages, pairs and the nats that each subject saves on them."""

    def __init__(self, subjects: list[str], words: list[str], languages: list[str], share: np.ndarray, pairs: list[np.ndarray]):
        self.subjects, self.words, self.languages, self.share, self.pairs = subjects, words, languages, share, pairs
        self.uni: list[np.ndarray] = []
        self.bi: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.known_pair: list[np.ndarray] = []
        self.threshold = np.full(len(subjects) + 1, 0.1)

    def numbers(self) -> _Numbers:
        return _Numbers({w: i for i, w in enumerate(self.words)})

    def pair_of(self, lang: int, e: Encoded) -> np.ndarray:
        """The number of the pair that each word closes with the word before it in its sentence, -1 where the language has no such pair."""
        out = np.full(len(e.tok), -1)
        keys = self.pairs[lang]
        if len(keys) and len(e.tok) > 1:
            both = (e.tok[1:] >= 0) & (e.tok[:-1] >= 0) & (e.sentence[1:] == e.sentence[:-1])
            want = e.tok[:-1] * len(self.words) + e.tok[1:]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out[1:] = np.where(both & (keys[at] == want), at, -1)
        return out

    def scores(self, lang_of: np.ndarray, e: Encoded) -> np.ndarray:
        """Mean nats saved a word, one row for each sentence, one column for each subject and for none."""
        out = np.zeros((len(e.size), len(self.subjects) + 1))
        own = lang_of[e.of] if len(e.of) else np.zeros(0, int)
        for lang in np.unique(own[own >= 0]).tolist():
            mine = (own == lang)[e.sentence]
            tok, pair = np.maximum(e.tok, 0), self.pair_of(lang, e)
            v = self.uni[lang][tok]
            v[(e.tok < 0) | ~self.known[lang][tok]] = 0
            hit = np.flatnonzero(pair >= 0)
            hit = hit[self.known_pair[lang][pair[hit]]]
            v[hit] = 0.5 * v[hit] + 0.5 * self.bi[lang][pair[hit]]
            v[~mine] = 0
            out += np.add.reduceat(v, e.at, axis=0)
        return out / np.maximum(e.size, 1)[:, None]

    def finish(self, uni: list[np.ndarray], bi: list[np.ndarray], ground: "Background") -> None:
        """Turn counts (words x subjects, pairs x subjects) of each language into nats saved against the background."""
        self.uni, self.bi, self.known, self.known_pair = [], [], [], []
        for lang, keys in enumerate(self.pairs):
            c, back, bback = uni[lang].astype(float), ground.uni[lang].astype(float), ground.bi[lang].astype(float)
            whole = ground.total[lang] + 0.5 * ground.size[lang] + 1e-9
            sums = c.sum(0)
            base = (back + 0.5) / whole
            u = np.where(sums > 0, np.log((c + STRENGTH) / (sums * base[:, None] + STRENGTH)), -3.0)
            known = back >= LEAST_WORD
            x, y = keys // max(len(self.words), 1), keys % max(len(self.words), 1)
            base2 = ((bback + 1.0) / (back[x] + 2.0))[:, None]  # background probability of y after x
            p = np.exp(u[y]) * ((back[y] + 0.5) / whole)[:, None]
            lower = 0.5 * base2 * np.exp(np.clip(u[y], -3, 3)) + 0.5 * p
            high = (bi[lang] + 4.0 * lower) / (c[x] + 4.0)
            self.uni.append(u.astype(np.float32))
            self.bi.append(np.where(sums > 0, np.clip(np.log(high / base2), -6, 6), -3.0).astype(np.float32))
            self.known.append(known)
            self.known_pair.append((bback >= LEAST_PAIR) & known[x] & known[y])


class Background:
    """Counts of each language over the whole corpus: of the model's words and pairs, of all words, of distinct words."""

    def __init__(self, model: Models):
        self.uni = [np.zeros(len(model.words), np.int64) for _ in model.languages]
        self.bi = [np.zeros(len(k), np.int64) for k in model.pairs]
        self.total, self.size = [0] * len(model.languages), [0] * len(model.languages)


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


def background(docs: DataFrame, text: str, model: Models) -> Background:
    """The background over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        numbers, sums, new = own.numbers(), Background(own), [set() for _ in own.languages]
        cols = ["l", "kind", "i", "word", "n"]

        def fresh() -> pd.DataFrame:
            rows = [(lang, 2, 0, w, 1) for lang, ws in enumerate(new) for w in ws]
            for ws in new:
                ws.clear()
            return pd.DataFrame(rows, columns=cols)

        for batch in batches:
            for part in _blocks(batch.iloc[:, 0]):
                e = Encoded(map(sentence_words, part), numbers)
                lang_of = e.languages(own.share, len(part))
                for n, miss in enumerate(e.unknown):
                    if lang_of[n] >= 0:
                        new[lang_of[n]].update(miss)
                of_word = lang_of[e.of][e.sentence] if len(e.of) else np.zeros(0, int)
                for lang in np.unique(of_word[of_word >= 0]).tolist():
                    mine = of_word == lang
                    sums.total[lang] += int(mine.sum())
                    sums.uni[lang] += np.bincount(e.tok[mine & (e.tok >= 0)], minlength=len(own.words))
                    pair = own.pair_of(lang, e)
                    sums.bi[lang] += np.bincount(pair[mine & (pair >= 0)], minlength=len(own.pairs[lang]))
                if sum(map(len, new)) > 200_000:
                    yield fresh()
        yield fresh()
        for lang in range(len(own.languages)):
            for kind, c in ((0, sums.uni[lang]), (1, sums.bi[lang])):
                i = np.flatnonzero(c)
                yield pd.DataFrame({"l": lang, "kind": kind, "i": i, "word": None, "n": c[i]}, columns=cols)
            yield pd.DataFrame([(lang, 3, 0, None, sums.total[lang])], columns=cols)

    counted = spread(docs.select(text).where(F.col(text).isNotNull())).mapInPandas(run, "l int, kind int, i long, word string, n long")
    counted = durable(counted.groupBy("l", "kind", "i", "word").agg(F.sum("n").alias("n")))
    out = Background(model)
    for r in counted.where("kind = 2").groupBy("l").agg(F.count("*").alias("n")).collect():
        out.size[r.l] += r.n
    known = counted.where("kind <> 2").select("l", "kind", "i", "n").toPandas()  # no more than the sample and the items have
    release(counted)
    for (lang, kind), part in known.groupby(["l", "kind"]):
        if kind == 3:
            out.total[lang] += int(part["n"].sum())
        else:
            (out.uni if kind == 0 else out.bi)[lang][part["i"].to_numpy()] = part["n"].to_numpy()
            out.size[lang] += len(part) * (kind == 0)
    shared.unpersist()
    return out


def _vocabulary(data: list[list[list[str]]], langs: list[str | None], items: list[list[list[str]]], subjects: list[str]) -> Models:
    """Words, pairs and word languages of the sample and the items."""
    words = sorted({w.lower() for ss in (*data, *items) for ws in ss for w in ws})
    index = {w: i for i, w in enumerate(words)}
    names = sorted({x for x in langs if x}) or [""]
    share = np.zeros((len(words), len(names)))
    big = Counter(x for x in langs if x)
    for ss, x in zip(data, langs):
        if x:  # a language with many documents is not the likelier one
            share[list({index[w.lower()] for ws in ss for w in ws}), names.index(x)] += 1 / big[x]
    share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
    return Models(subjects, words, names, share, [np.zeros(0, np.int64)] * len(names))


def learn(
    docs: DataFrame, labels: DataFrame, subjects: DataFrame, none_like: DataFrame | None = None,
    key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 6_000, rounds: int = 3,
) -> Models:
    names = sorted({r[0] for r in subjects.select("subject").collect() if r[0]})
    marked = labels.where(F.col("subject").isin(*names)).groupBy(key).agg(F.sort_array(F.collect_set("subject")).alias("own"))
    n = marked.count()
    rate = min(1.0, max_docs / n) if n else 0.0
    marked = marked.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000))
    sample = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), F.col(lang).alias("l")).join(F.broadcast(marked), key)
    rows = sorted({r[0]: r for r in sample.dropDuplicates([key]).collect()}.items())
    data, langs, owned = [], [], []
    for _, r in rows:
        if ss := sentence_words(r.t):
            data.append(ss)
            langs.append(r.l)
            owned.append(set(r.own))
    items = [ss for r in (none_like.toLocalIterator() if none_like is not None else ()) if (ss := sentence_words(r[0]))]
    model = _vocabulary(data, langs, items, names)
    numbers = model.numbers()
    e, other = Encoded(data, numbers), Encoded(items, numbers)
    lang_of, lang_other = e.languages(model.share, len(data)), other.languages(model.share, len(items))
    of_sentence = lang_of[e.of] if len(e.of) else np.zeros(0, int)
    other_sentence = lang_other[other.of] if len(other.of) else np.zeros(0, int)

    def pairs(enc: Encoded, mine: np.ndarray) -> np.ndarray:
        both = (enc.sentence[1:] == enc.sentence[:-1]) & mine[enc.sentence][1:]
        return (enc.tok[:-1] * len(model.words) + enc.tok[1:])[both]

    model.pairs = [np.unique(np.r_[pairs(e, of_sentence == k), pairs(other, other_sentence == k)]) for k in range(len(model.languages))]
    ground = background(docs, text, model)

    def counts(enc: Encoded, of: np.ndarray, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs of the sentences of language k by the subject chosen for each (-1: none of them)."""
        s, width = np.where(of == k, chosen, -1)[enc.sentence], len(names) + 1
        pair, use = model.pair_of(k, enc), s >= 0
        both = use & (pair >= 0)
        uni = np.bincount(enc.tok[use] * width + s[use], minlength=len(model.words) * width).reshape(-1, width)
        return uni, np.bincount(pair[both] * width + s[both], minlength=len(model.pairs[k]) * width).reshape(-1, width)

    like = [counts(other, other_sentence, k, np.full(len(other.size), len(names))) for k in range(len(model.languages))]
    for k, (u, b) in enumerate(like):  # the items are part of the background
        ground.total[k] += int(u.sum())
        ground.size[k] += int(((u.sum(1) > 0) & (ground.uni[k] == 0)).sum())
        ground.uni[k] += u.sum(1)
        ground.bi[k] += b.sum(1)
    single = np.array([names.index(next(iter(o))) if len(o) == 1 else -1 for o in owned], np.int64)
    may = np.array([[x in o for x in names] for o in owned], bool).reshape(len(owned), len(names))
    for k in range(rounds + 1):
        if k == 0:
            chosen = single[e.of] if len(e.of) else np.zeros(0, np.int64)
        else:
            sc = model.scores(lang_of, e)
            top = sc.argmax(1)
            sure = sc[np.arange(len(top)), top] > 0.35
            chosen = np.where(sure | np.c_[may, np.zeros(len(may), bool)][e.of, top], top, -1)
        made = [tuple(a + b for a, b in zip(counts(e, of_sentence, i, chosen), like[i])) for i in range(len(model.languages))]
        model.finish([u for u, _ in made], [b for _, b in made], ground)
    model.threshold = _calibrate(model.scores(lang_of, e), e, may, len(names))
    return model


def _parts(sc: np.ndarray, e: Encoded, threshold: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentences of each text on each subject, sentences of each text)."""
    top = sc.argmax(1)
    ok = sc[np.arange(len(top)), top] > threshold[top]
    width = sc.shape[1]
    n = np.bincount((e.of * width + top)[ok], minlength=texts * width).reshape(texts, width)
    return n[:, :-1], np.bincount(e.of, minlength=texts)


def _calibrate(sc: np.ndarray, e: Encoded, may: np.ndarray, subjects: int, share: float = 0.25, least: int = 20) -> np.ndarray:
    """For each subject the threshold under which its acceptance agrees best (F1) with the labels of the sample.

    A subject starts from the threshold that is best over all of them and leaves it only for a better one of its own, and only if it has ``least`` labels.
    """
    if not len(sc):
        return np.full(subjects + 1, 0.1)
    tries = []
    for t in GRID:
        n, size = _parts(sc, e, np.full(subjects + 1, t), len(may))
        got = n >= share * size[:, None] - 1e-9
        got &= n > 0
        tries.append((2 * (got & may).sum(0), got.sum(0) + may.sum(0)))
    whole = [h.sum() / max(s.sum(), 1) for h, s in tries]
    best = 0
    for k in range(1, len(GRID)):
        if whole[k] > whole[best] + 1e-3:
            best = k
    out = np.full(subjects + 1, GRID[best])
    for j in range(subjects):
        f1 = [h[j] / max(s[j], 1) for h, s in tries]
        k = int(np.argmax(f1))
        if may[:, j].sum() >= least and f1[k] > f1[best] + 0.01:
            out[j] = GRID[k]
    return out


def assign(docs: DataFrame, model: Models, key: str = "doc_id", text: str = "text", share: float = 0.25) -> DataFrame:
    """(key, subject, part, sentences): every subject that at least ``share`` of a document's sentences are on."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        numbers, names = own.numbers(), np.array([*own.subjects, NONE], object)
        for b in batches:
            lo = 0
            for part in _blocks(b.iloc[:, 1]):
                keys = b.iloc[lo : lo + len(part), 0].to_numpy()
                lo += len(part)
                e = Encoded(map(sentence_words, part), numbers)
                if not len(e.size):
                    continue
                n, size = _parts(own.scores(e.languages(own.share, len(part)), e), e, own.threshold, len(part))
                i, j = np.nonzero((n > 0) & (n >= share * size[:, None] - 1e-9))
                yield pd.DataFrame({key: keys[i], "subject": names[j], "part": n[i, j] / size[i], "sentences": size[i]})

    return spread(docs.select(key, text), key).mapInPandas(run, f"`{key}` {kind}, subject string, part double, sentences int")
