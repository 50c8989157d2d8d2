"""Language of documents and of the passages of mixed documents (problem 4).

Hierarchical discrimination: a linear support vector machine per family (one against the rest) finds the
family of a sentence, one-versus-one machines separate the languages within it. Features are hashed
character n-grams (1 to 4) of the consistent form of the text; the scores of all sentences of a block of texts come from one
gather of weight rows and one segmented sum. A Viterbi pass with a price for each change of language joins
sentences into passages, each with a confidence (its mean posterior).

The machines are fitted on the whole texts of about ``per_language`` labelled rows of each language (a documented bound), cut
into passages; labels are noisy, so passages that a first fit contradicts are left out of the second. Everything else reads all
rows and whole texts. A text without letters, null or empty, has no passage; a sentence that is mostly garbled signs counts for its
neighbours' language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release
from .sentences import starts
from .textform import fold

# The languages and their families.
FAMILIES = {
    "germanic": ("en", "de"), "romance": ("fr", "es", "pt"), "uralic": ("hu",), "slavic": ("ru",),
    "indic": ("hi",), "sinitic": ("zh",), "japonic": ("ja",),
}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
# Codes and names by which a label may mean each language.
NAMES = {
    "en": "en eng english inglés inglês anglais englisch angol", "hu": "hu hun hungarian magyar ungarisch hongrois húngaro",
    "de": "de deu ger german deutsch német allemand alemán alemão", "fr": "fr fra fre french français francais französisch francia francés francês",
    "es": "es spa esp spanish español espanol castellano spanisch spanyol espagnol espanhol", "pt": "pt por portuguese português portugues portugiesisch portugál portugais portugués",
    "ru": "ru rus russian русский russisch orosz russe ruso russo", "ja": "ja jpn jp japanese 日本語 nihongo japanisch japán japonais japonés japonês",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 普通话 mandarin kínai chinois chino chinês", "hi": "hi hin hindi हिन्दी हिंदी",
}
_BITS = 16
_PAIRS = [(a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :]]
_SOFT_BREAK = re.compile(r"(?<=[^\n])\n(?=[^\n])")
#: A sentence also ends where a script without capitals follows the stop of a word in one that has them.
_NEW_SCRIPT = re.compile("(?<=[^\\W\\d_A-Z]{2}[.!?…])[ \n]+(?=[\u0900-\u097f\u3040-\u30ff\u3400-\u9fff])")
SHARP, SWITCH = 4.0, 5.0


def label_expr(col: str):
    """The language a label names, 'other' for another one, null for none."""
    key = F.lower(F.trim(F.regexp_replace(F.col(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    base = F.regexp_extract(key, r"^([\p{L}\p{M}]+)(?:[-_].*|\s*\(.*)?$", 1)
    out = F.lit(None).cast("string")
    out = F.when(base.rlike(r"^\p{L}{2,}$") & ~base.isin("und", "unknown", "none", "null", "mul", "mis", "zxx", "na", "xx", "unk"), "other").otherwise(out)
    for lang, names in NAMES.items():
        out = F.when(base.isin(*names.split()), lang).otherwise(out)
    return out


def _classes() -> np.ndarray:
    """Lower-case letters stand for themselves, digits, signs and blanks for one value each."""
    out = np.arange(0x110000, dtype=np.uint32)
    text = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000)]
    for i, c in enumerate(text):
        low = c.lower()
        out[i] = ord(low) if len(low) == 1 else i
        if not (c.isalpha() or 0x900 <= i < 0x980 or c in "'’"):
            out[i] = 0x30 if c.isdigit() else 32
    return out


_CLASSES: list[np.ndarray] = []


def _grams(text: str) -> np.ndarray:
    """Feature numbers, one row for each of n = 1..4, one column for each character."""
    if not _CLASSES:
        _CLASSES.append(_classes())
    c = _CLASSES[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    out = np.empty((4, len(c)), np.int32)
    h = c.astype(np.uint32)
    with np.errstate(over="ignore"):
        for n in range(4):
            if n:
                nxt = np.zeros(len(c), np.uint32)
                nxt[: len(c) - n] = c[n:]
                h = h * np.uint32(0x01000193) ^ nxt
            out[n] = ((h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _BITS)
    return out


class Discriminator:
    """Weights of the family machines and the one-versus-one machines, in one matrix."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, present: list[str]):
        self.weights, self.bias, self.present = weights, bias, present

    def log_probs(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probability of each language for rows of summed weights."""
        m = sums / np.maximum(lengths, 1)[:, None] * 10 + self.bias
        fam = list(FAMILIES)
        f = SHARP * m[:, : len(fam)]
        for j, name in enumerate(fam):
            if not any(x in self.present for x in FAMILIES[name]):
                f[:, j] = -1e3
        f = f - np.logaddexp.reduce(f, axis=1, keepdims=True)
        out = np.empty((len(m), len(LANGUAGES)))
        for j, name in enumerate(fam):
            own = FAMILIES[name]
            w = np.zeros((len(m), len(own)))
            for k, (a, b) in enumerate(_PAIRS):
                if a in own:
                    z = SHARP * m[:, len(fam) + k]
                    w[:, own.index(a)] -= np.logaddexp(0, -z)
                    w[:, own.index(b)] -= np.logaddexp(0, z)
            for i, x in enumerate(own):
                if x not in self.present:
                    w[:, i] = -1e3
            w -= np.logaddexp.reduce(w, axis=1, keepdims=True)
            for i, x in enumerate(own):
                out[:, LANGUAGES.index(x)] = f[:, j] + w[:, i]
        return out


def _targets(lang: str) -> np.ndarray:
    fam = [1.0 if lang in v else -1.0 for v in FAMILIES.values()]
    return np.array(fam + [1.0 if lang == a else -1.0 if lang == b else 0.0 for a, b in _PAIRS])


def fit(samples: list[tuple[str, str]], epochs: int = 6, seed: int = 7) -> Discriminator:
    """Hinge-loss fit on (text, language), twice: the second time without passages the first fit contradicts."""
    feats = []
    for text, lang in samples:
        g = _grams(text).ravel()
        idx, n = np.unique(g, return_counts=True)
        feats.append((idx, (n / len(text) * 10).astype(np.float32), lang))
    present = sorted({x[2] for x in feats})
    model = _sgd(feats, present, epochs, seed)
    kept = []
    for idx, n, lang in feats:
        s = (n[:, None] * model.weights[idx]).sum(0, keepdims=True)
        if LANGUAGES[int(model.log_probs(s / 10, np.ones(1)).argmax())] == lang:
            kept.append((idx, n, lang))
    return _sgd(kept, sorted({x[2] for x in kept}), epochs, seed) if kept else model


def _sgd(feats: list, present: list[str], epochs: int, seed: int) -> Discriminator:
    cols = len(FAMILIES) + len(_PAIRS)
    w, b = np.zeros((1 << _BITS, cols), np.float32), np.zeros(cols, np.float32)
    total, tb, steps = np.zeros_like(w), np.zeros_like(b), 0
    rng, y = np.random.default_rng(seed), {x: _targets(x).astype(np.float32) for x in LANGUAGES}
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(len(feats)):
            idx, n, lang = feats[i]
            m = n @ w[idx] + b
            step = np.where(y[lang] * m < 1, y[lang], 0) * rate
            if step.any():
                w[idx] += n[:, None] * step * 0.1
                b += step * 0.01
        w *= 0.998
        total += w
        tb += b
        steps += 1
    return Discriminator(total / max(steps, 1), tb / max(steps, 1), present)


#: Code points whose weights are gathered at once; a longer text is a block of its own.
BLOCK = 200_000
_GAP = "\n" * 4  # no n-gram reaches from one text into the next


def passages(texts: list[str | None], model: Discriminator) -> list[list[tuple[int, int, str, float, int]]]:
    """(start, end, language, confidence, sentences) of the passages of each of several texts in their consistent form."""
    out: list[list[tuple[int, int, str, float, int]]] = [[] for _ in texts]
    if not model.present:
        return out
    block: list[tuple[int, str, list[int]]] = []
    size = 0
    for n, t in enumerate([*texts, None]):
        flat = _SOFT_BREAK.sub(" ", t) if t else ""
        at = sentence_bounds(flat)
        if block and (n == len(texts) or size + len(flat) > BLOCK):
            for (i, _, _), got in zip(block, _passages([x[1] for x in block], [x[2] for x in block], model)):
                out[i] = got
            block, size = [], 0
        if at:
            block.append((n, flat, at))
            size += len(flat)
    return out


def sentence_bounds(flat: str) -> list[int]:
    at = starts(flat)
    extra = [m.end() for m in _NEW_SCRIPT.finditer(flat)] if at else []
    return sorted({*at, *extra}) if extra else at


def _passages(flats: list[str], ats: list[list[int]], model: Discriminator) -> list[list[tuple[int, int, str, float, int]]]:
    flat = _GAP.join(flats) + _GAP
    cps = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(x) + len(_GAP) for x in flats])
    first = np.r_[0, ends[:-1]]
    # the bounds of all sentences, and behind each text that of the gap
    bounds = np.concatenate([np.r_[np.array(at) + lo, lo + len(x)] for at, lo, x in zip(ats, first, flats)])
    real = np.ones(len(bounds), bool)
    real[np.cumsum([len(at) + 1 for at in ats]) - 1] = False
    length = np.diff(np.r_[bounds, len(flat)])[real]
    g = _grams(flat)
    sums = model.weights.take(g[0], 0, mode="clip")
    for n in range(1, 4):
        sums += model.weights.take(g[n], 0, mode="clip")
    lp = model.log_probs(np.add.reduceat(sums, bounds, axis=0)[real].astype(float), length)
    weird = ((cps >= 0x80) & (cps < 0x250) | (cps >= 0x2190) & (cps < 0x2600) | (cps == 0xFFFD)).astype(np.int64)
    bad = np.add.reduceat(weird, bounds)[real] > 0.3 * length
    # longer sentences say more; garbled ones say nothing
    e = np.maximum(lp, -12) * np.where(bad, 0.0, np.clip(length / 40, 0.3, 1.5))[:, None]
    best, told, post = e.argmax(1), ~bad, np.exp(lp)
    out, lo = [], 0
    for at, x in zip(ats, flats):
        hi = lo + len(at)
        own = best[lo:hi][told[lo:hi]]
        # one language that is the likeliest of every sentence needs no search
        path = [int(own[0])] * len(at) if len(own) and (own == own[0]).all() else _viterbi(e[lo:hi])
        ends_, got, k = [*at, len(x)], [], 0
        for i in range(1, len(at) + 1):
            if i == len(at) or path[i] != path[k]:
                conf = float(post[lo + k : lo + i, path[k]].mean())
                got.append((ends_[k], ends_[i], LANGUAGES[path[k]], round(conf, 4), i - k))
                k = i
        out.append(got)
        lo = hi
    return out


def _viterbi(e: np.ndarray) -> list[int]:
    back, score = [], e[0]
    for row in e[1:]:
        best = int(score.argmax())
        jump = score[best] - SWITCH
        frm = np.where(score >= jump, np.arange(len(score)), best)
        back.append(frm)
        score = np.maximum(score, jump) + row
    j = int(score.argmax())
    path = [j]
    for frm in reversed(back):
        j = int(frm[j])
        path.append(j)
    return path[::-1]


def learn(texts: DataFrame, key: str, text: str, labels: DataFrame, group: str, label: str, per_language: int = 250, chars: int = 400) -> Discriminator:
    """Fit on the whole texts of about ``per_language`` rows of each label, cut into passages of ``chars`` characters.

    ``texts`` has (key, group, text), ``labels`` (group, label). The sample is the only bounded part: distinct texts are drawn by their hash over
    all rows of each label by itself, so neither copies nor a large language crowd out another. Keys are drawn first, and only the
    texts of the drawn rows are fetched. No labels give a model that finds nothing.
    """
    named = labels.where(F.col(label).isin(*LANGUAGES)).select(group, F.col(label).alias("l"))
    rows = texts.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("k"), group, F.xxhash64(text).alias("h"))
    rows = durable(rows.join(named, group).select("k", "h", "l"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").agg(F.approx_count_distinct("h")).collect()}
    rate = F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("l") == lang, int(min(1.0, per_language / max(n, 1)) * 1_000_000)).otherwise(rate)
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < rate).groupBy("l", "h").agg(F.min("k").alias("k"))
    drawn = texts.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(F.broadcast(drawn), ["k", "h"])
    got = sorted({(r.l, r.t) for r in drawn.collect()})
    release(rows)
    folded = fold(pa.array([t for _, t in got], pa.string())).to_pylist()
    samples = []
    for (lang, _), t in zip(got, folded):
        flat = _SOFT_BREAK.sub(" ", t)
        n = max(1, round(len(flat) / chars))
        parts = (flat[len(flat) * i // n : len(flat) * (i + 1) // n] for i in range(n))
        samples += [(p, lang) for p in parts if any(map(str.isalpha, p))]
    return fit(samples)


def passage_table(df: DataFrame, key: str, text: str, model: Discriminator, *keep: str) -> DataFrame:
    """DataFrame (key, text, kept columns) -> one row per passage, with the text's main language."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.present))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    cols = [key, *keep, "passage_no", "start_pos", "end_pos", "lang", "confidence", "sentences", "main_lang"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Discriminator(*shared.value)
        for b in batches:
            rows = []
            for lo in range(0, len(b), 200):
                part = b.iloc[lo : lo + 200]
                folded = fold(pa.array(part.iloc[:, -1], pa.string())).to_pylist()
                for ids, got in zip(part.iloc[:, :-1].itertuples(index=False, name=None), passages(folded, own)):
                    size: dict[str, tuple[int, int]] = {}
                    for s, e, lang, _, k in got:  # sentences weigh alike in all scripts
                        n0, c0 = size.get(lang, (0, 0))
                        size[lang] = (n0 + k, c0 + e - s)
                    main = max(size, key=lambda x: (size[x], x)) if size else None
                    rows += [(*ids, n, *g, main) for n, g in enumerate(got)]
            yield pd.DataFrame(rows, columns=cols)

    schema = kinds + ", passage_no int, start_pos int, end_pos int, lang string, confidence double, sentences int, main_lang string"
    return df.select(key, *keep, text).mapInPandas(run, schema)
