"""Column functions on text: counts, keys, classes, tags, speeds, times. All stay in whole-stage codegen."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """The blank-separated words; none for null."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "[" + P.BLANKS + "]+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^[{P.BLANKS}]+|[{P.BLANKS}]+$", "")


def squeeze(text: Column | str) -> Column:
    """Runs of blanks become one space."""
    return strip(F.regexp_replace(_c(text), f"[{P.BLANKS}]+", " "))


def composed(text: Column | str) -> Column:
    """The NFKC form; texts of ASCII never reach the batch function."""

    def form(it):
        for s in it:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)

    s = _c(text)
    made = F.pandas_udf("string", F.PandasUDFType.SCALAR_ITER)(form)
    return F.coalesce(made(F.when(~s.rlike("^\\p{ASCII}*$"), s)), s)


def normalise(text: Column | str, compose: bool = True) -> Column:
    """NFKC, line ends, no-break spaces, invisible and control characters."""
    out = F.coalesce(_c(text), F.lit(""))
    out = F.regexp_replace(composed(out) if compose else out, "\r\n?", "\n")
    out = F.translate(out, "\xa0​﻿�", " ")
    return F.regexp_replace(out, P.CONTROL, " ")


def fold_ascii(text: Column | str) -> Column:
    """Small letters for A-Z only, as a caseless SQL collation compares."""
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_explicit_section(line: Column | str, most: int = 150) -> Column:
    s = strip(F.coalesce(_c(line), F.lit("")))
    return (F.length(s) > 0) & (F.length(s) <= most) & s.rlike(P.SECTION)


def is_caps_heading(line: Column | str) -> Column:
    """A line in capitals that is no speaker's label, no roman number and no initials."""
    s = strip(F.coalesce(_c(line), F.lit("")))
    return (
        (F.length(s) > 3) & (F.length(s) < 80) & (F.upper(s) == s) & (F.lower(s) != s) & ~s.endswith(":")
        & ~s.rlike(P.ROMAN) & ~s.rlike(P.INITIALS_LINE) & s.rlike(P.CAPITALS)
    )


def section_type(title: Column | str) -> Column:
    """The first class whose pattern the title begins with, else 'chapter'."""
    s = strip(_c(title))
    out = F.lit(None).cast("string")
    for name in P.NAMED_SECTIONS:
        out = F.coalesce(out, F.when(s.rlike(f"(?iuU)^\\s*{name}\\b"), name))
    return F.coalesce(out, F.when(s.rlike(P.PART), "part"), F.lit("chapter"))


def with_language(df: DataFrame, text: str, out: str = "lang", default: str = "en") -> DataFrame:
    """Adds hu and en (counts of evidence in the first 100,000 characters) and the language: 'hu' on enough of it, else the default.

    The words are taken out once, as a column of their own.
    """
    df = df.withColumn("_s", F.lower(F.substring(F.coalesce(_c(text), F.lit("")), 1, 100_000)))
    df = df.withColumn("_w", F.regexp_extract_all("_s", F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), 1))
    twice = F.length("_s") - F.length(F.translate("_s", "őű", ""))
    df = df.withColumn("hu", F.size(F.filter("_w", lambda w: w.isin(P.HUNGARIAN))) + 2 * twice).withColumn("en", F.size(F.filter("_w", lambda w: w.isin(P.ENGLISH))))
    return df.withColumn(out, F.when((F.col("hu") >= 5) & (F.col("hu") > F.col("en") * 1.2), "hu").otherwise(default)).drop("_s", "_w")


def title_key(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " "))


def has_dialogue(text: Column | str) -> Column:
    s = F.coalesce(_c(text), F.lit(""))
    return s.rlike(P.PAIRED_QUOTE) | s.rlike(P.DASH_SPEECH)


def quote_inner(text: Column | str) -> Column:
    """The inside of the first quotation, or null."""
    first = F.regexp_extract(_c(text), "(" + P.PAIRED_QUOTE + ")", 1)
    return F.when(F.length(first) > 2, F.substring(first, F.lit(2), F.length(first) - 2))


def with_evidence(df: DataFrame, text: str, out: str = "evidence") -> DataFrame:
    """Adds the text a tag is judged by: the first quotation, what precedes and what follows it, cut free of blanks, commas, stops and hyphens.

    Steps are columns of their own, so that no expression is compiled more than once.
    """

    def cut(x: Column) -> Column:
        return F.nullif(F.regexp_replace(x, "^[ ,.\\-]+|[ ,.\\-]+$", ""), F.lit(""))

    first = F.regexp_extract("_s", "(" + P.PAIRED_QUOTE + ")", 1)
    df = df.withColumn("_s", strip(F.coalesce(_c(text), F.lit("")))).withColumn("_f", first).withColumn("_at", F.instr("_s", F.col("_f")))
    inner = F.nullif(strip(F.substring("_f", F.lit(2), F.length("_f") - 2)), F.lit(""))
    parts = F.concat_ws(" ", inner, cut(F.substring("_s", F.lit(1), F.col("_at") - 1)), cut(F.substring("_s", F.col("_at") + F.length("_f"), F.length("_s"))))
    return df.withColumn(out, F.when(F.length("_f") > 0, parts).otherwise(F.col("_s"))).drop("_s", "_f", "_at")


# What a quotation must consist of to count as assent.
ASSENT = (
    "yes", "yeah", "yep", "yup", "okay", "ok", "sure", "right", "indeed", "exactly", "correct", "of course", "certainly", "i know", "i see", "all right",
)


def with_tag(df: DataFrame, text: str, is_dialogue: Column, out: str = "tag") -> DataFrame:
    """Adds the tag of the first word list that matches the evidence; null for narration. Assent must be all there is."""
    df = with_evidence(df, text, "_ev")
    plain = squeeze(F.regexp_replace(F.lower("_ev"), "[^a-z0-9\\s']", " "))
    tag = F.lit(None).cast("string")
    for pattern, name in P.TAGS:
        hit = F.col("_ev").rlike(pattern)
        tag = F.coalesce(tag, F.when(hit & plain.isin(*ASSENT) if name.startswith("[conf") else hit, name))
    return df.withColumn(out, F.when(is_dialogue, tag)).drop("_ev")


def inject_tag(text: Column | str, tag: Column | str) -> Column:
    """The tag goes inside the first quotation, else before the text."""
    s, t = _c(text), _c(tag)
    first = F.regexp_extract(s, "(" + P.PAIRED_QUOTE + ")", 1)
    at = F.instr(s, first)
    inner = strip(F.substring(first, F.lit(2), F.length(first) - 2))
    inside = F.concat(F.substring(s, F.lit(1), at), t, F.lit(" "), inner, F.substring(s, at + F.length(first) - 1, F.length(s)))
    return F.when(t.isNull(), s).when(F.length(first) > 0, inside).otherwise(strip(F.concat(t, F.lit(" "), s)))


def scene_speed(text: Column | str) -> Column:
    s = F.coalesce(_c(text), F.lit(""))
    return F.when(F.regexp_count(s, F.lit(P.ACTION)) >= 3, 1.15).when(F.regexp_count(s, F.lit(P.SLOW)) >= 2, 0.9).otherwise(1.0)


def segment_speed(text: Column | str, base: Column | str, is_dialogue: Column | str, tag: Column | str) -> Column:
    """Narration is held back; whispers and sighs are slow, muttering is slower than plain, laughter is quick, broken sentences drag."""
    s, t, d = _c(text), F.coalesce(_c(tag), F.lit("")), _c(is_dialogue).cast("boolean")
    v = F.when(d, _c(base)).otherwise(F.least(_c(base), F.lit(1.05)))
    v = (
        F.when(s.rlike(P.WHISPER) | (t == "[sigh]"), F.least(v, F.lit(0.94)))
        .when(t == "[dissatisfaction-hnn]", F.least(v, F.lit(0.97)))
        .when((t == "[laughter]") & d, F.greatest(v, F.lit(1.03)))
        .otherwise(v)
    )
    slow = s.contains("...") | s.contains(" -- ") | s.contains(";") | s.contains(":")
    return F.round(F.when(slow, F.least(v, F.lit(0.98))).otherwise(v), 2)


def whisper_instruct(instruct: Column | str, text: Column | str) -> Column:
    i = _c(instruct)
    need = _c(text).rlike(P.WHISPER) & ~F.lower(F.coalesce(i, F.lit(""))).contains("whisper")
    return F.when(need & i.isNotNull() & (i != ""), F.concat(i, F.lit(", whisper"))).otherwise(i)


def voice_colour(name: Column | str) -> Column:
    """One of fifteen colours by the digest of the name: as 16 is 1 modulo 15, the sum of the hex digits decides."""
    digits = F.split(F.md5(F.lower(_c(name))), "")
    total = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int"))
    return F.element_at(F.array(*map(F.lit, P.COLOURS)), F.pmod(total, F.lit(15)) + 1)


def pause_after(text: Column | str, ends_paragraph: Column | str, is_dialogue: Column | str, next_is_dialogue: Column | str) -> Column:
    s = F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"[{P.BLANKS}]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "[\"'”’»]+$", ""), f"[{P.BLANKS}]+$", "")
    both = (F.coalesce(_c(is_dialogue).cast("int"), F.lit(0)) != 0) & (F.coalesce(_c(next_is_dialogue).cast("int"), F.lit(0)) != 0)
    return (
        F.when(s.endswith("...") | s.endswith("…"), P.PAUSE_ELLIPSIS)
        .when(F.coalesce(_c(ends_paragraph).cast("int"), F.lit(0)) != 0, P.PAUSE_PARAGRAPH)
        .when(both, P.PAUSE_DIALOGUE)
        .otherwise(P.PAUSE)
    )


def srt_time(seconds: Column | str) -> Column:
    s = _c(seconds)
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor((whole % 3600) / 60), whole % 60, F.floor((s % 1) * 1000))


def ass_colour(rgb: Column | str) -> Column:
    h = F.regexp_replace(_c(rgb), "^#+", "")
    return F.upper(F.concat(F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def safe_name(name: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_c(name), F.lit("")), f"[^\\p{{L}}\\p{{N}}_{P.BLANKS}-]", ""), f"^[{P.BLANKS}]+|[{P.BLANKS}]+$", "")
    s = F.substring(F.regexp_replace(s, f"[{P.BLANKS}]+", "_"), 1, 80)
    return F.when(s == "", "export").otherwise(s)


def export_dir(author: Column | str, title: Column | str) -> Column:
    one = F.coalesce(F.nullif(strip(_c(author)), F.lit("")), F.lit("Unknown"))
    two = F.coalesce(F.nullif(strip(_c(title)), F.lit("")), F.lit("Untitled"))
    s = F.regexp_replace(F.concat(one, F.lit(" - "), two), '[<>:"/\\\\|?*\\x00-\\x1f]', "")
    s = F.regexp_replace(F.regexp_replace(s, f"[{P.BLANKS}]+", " "), "^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 160), F.lit("")), F.lit("Unknown - Untitled"))


# Defaults and version that are part of a rendering's key.
STEPS, AUDIO_VERSION = 16, 2


def cache_key(text, instruct, ref, ref_text, speed, lang, normalize: bool = False, steps: int = STEPS) -> Column:
    """Digest of all a rendering depends on; a missing part is spelled None, the speed has two decimals."""

    def part(x) -> Column:
        return F.coalesce(_c(x).cast("string"), F.lit("None"))

    tail = F.lit(f"nt={int(normalize)}|ns={steps}|audio-cache-v={AUDIO_VERSION}")
    return F.md5(F.concat_ws("|", part(text), part(instruct), part(ref), part(ref_text), F.format_string("%.2f", _c(speed)), F.coalesce(_c(lang), F.lit("")), tail))


def clean_speaker(name: Column | str) -> Column:
    """A reported name without marks, appended fields, fragments of speech and placeholders; '' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_c(name), F.lit("")), f"[{P.BLANKS}]+", " "), "^[ \t\r\n.,;:!?\"'„”]+|[ \t\r\n.,;:!?\"'„”]+$", "")
    s = strip(F.element_at(F.split(s, "\\|"), 1))
    parts = F.transform(F.split(s, ","), strip)
    head, tail = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    fragment = (F.size(parts) == 2) & (word_count(head) > 1) & word_count(tail).between(1, 3)
    s = F.when(fragment, tail).otherwise(s)
    return F.when(F.lower(s).isin(*P.NON_SPEAKERS), "").otherwise(F.substring(s, 1, 120))


# The vocabulary of voice descriptions.
GENDERS = ("male", "female")
AGES = ("child", "teenager", "young adult", "middle-aged", "elderly")
PITCHES = ("very low pitch", "low pitch", "moderate pitch", "high pitch", "very high pitch")


def parse_instruct(instruct: Column | str) -> Column:
    """gender, age, pitch, accent (the last of a kind wins), styles and extras (all of them) of a comma list."""
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce(_c(instruct), F.lit(""))), ","), strip), lambda t: t != "")

    def is_accent(t: Column) -> Column:
        return t.endswith("accent") & ~t.isin(*GENDERS, *AGES, *PITCHES, "whisper")

    def last(test) -> Column:
        return F.try_element_at(F.filter(tokens, test), F.lit(-1))

    return F.struct(
        last(lambda t: t.isin(*GENDERS)).alias("gender"),
        last(lambda t: t.isin(*AGES)).alias("age"),
        last(lambda t: t.isin(*PITCHES)).alias("pitch"),
        last(is_accent).alias("accent"),
        F.filter(tokens, lambda t: t == "whisper").alias("styles"),
        F.filter(tokens, lambda t: ~t.isin(*GENDERS, *AGES, *PITCHES, "whisper") & ~is_accent(t)).alias("extras"),
    )


def stable_instruct(instruct: Column | str) -> Column:
    """A voice description without the combinations that render badly: male children and very low girls."""
    p = parse_instruct(instruct)
    young = F.coalesce(p["age"].isin("teenager", "child"), F.lit(False))
    boy, girl = young & F.coalesce(p["gender"] == "male", F.lit(False)), young & F.coalesce(p["gender"] == "female", F.lit(False))
    plain = F.coalesce(p["pitch"], F.lit("moderate pitch")).isin("moderate pitch", "very high pitch")
    pitch = (
        F.when(boy & plain, "high pitch")
        .when(boy & (p["pitch"] == "very low pitch"), "low pitch")
        .when(girl & ((p["pitch"] == "very low pitch") | (p["age"] == "teenager") & (p["pitch"] == "low pitch")), "moderate pitch")
        .otherwise(p["pitch"])
    )
    items = F.concat(F.array(p["gender"], F.when(~boy, p["age"]), pitch, p["accent"]), p["styles"], p["extras"])
    return F.nullif(F.array_join(F.filter(items, lambda t: t.isNotNull()), ", "), F.lit(""))


def speed_token(speed: Column | str) -> Column:
    v = _c(speed)
    return (
        F.when(v <= 0.72, "<|prosody:speed_very_slow|>").when(v < 0.94, "<|prosody:speed_slow|>")
        .when(v >= 1.32, "<|prosody:speed_very_fast|>").when(v > 1.08, "<|prosody:speed_fast|>").otherwise("")
    )


def instruct_tokens(instruct: Column | str) -> Column:
    v = F.lower(F.coalesce(_c(instruct), F.lit("")))
    pitch = F.when(v.contains("low pitch"), "<|prosody:pitch_low|>").when(v.contains("high pitch"), "<|prosody:pitch_high|>").otherwise("")
    return F.concat(F.when(v.contains("whisper"), "<|style:whispering|>").otherwise(""), pitch)


# Control tokens of the second engine for the tags of the first.
CONTROL_TOKENS = {
    "laughter": "<|sfx:laughter|>Haha", "sigh": "<|sfx:sigh|>Uh", "dissatisfaction-hnn": "<|emotion:bitterness|>", "confirmation-en": "",
    "question-ei": "<|emotion:contemplation|>", "question-oh": "<|emotion:surprise|>", "question-ah": "<|emotion:confusion|>", "surprise-ah": "<|emotion:surprise|>",
    "surprise-oh": "<|emotion:surprise|>", "surprise-wa": "<|emotion:awe|>", "surprise-yo": "<|emotion:elation|>",
}


def control_tokens(text: Column | str) -> Column:
    """Known tags become control tokens, unknown ones vanish."""
    s = _c(text)
    for tag, token in CONTROL_TOKENS.items():
        s = F.replace(s, F.lit(f"[{tag}]"), F.lit(token))
    return F.regexp_replace(s, "\\[[^\\[\\]]*\\]", "")


def normaliser_language(lang: Column | str, text: Column | str) -> Column:
    code = F.lower(strip(F.coalesce(_c(lang), F.lit(""))))
    return (
        F.when(code.isin("en", "english"), "en").when(code.isin("zh", "zh-cn", "zh-tw", "chinese", "mandarin"), "zh").when(code.isin("ja", "japanese"), "ja")
        .when(~code.isin("", "none", "auto"), code).when(_c(text).rlike("[\u4e00-\u9fff]"), "zh").when(_c(text).rlike("[\u3040-\u30ff]"), "ja").otherwise("en")
    )


def repair_glyphs(text: Column | str, lang: Column | str) -> Column:
    """Hungarian set with the wrong code page; other languages own these letters."""
    return F.when(F.lower(F.coalesce(_c(lang), F.lit(""))).isin("hu", "hungarian"), F.translate(_c(text), "õûÕÛ", "őűŐŰ")).otherwise(_c(text))


def word_spans(df: DataFrame, text: str, seconds: str, *keep: str) -> DataFrame:
    """(kept columns, i, word, t0, t1): each word's equal part of the duration; the words are counted once a text."""
    df = df.withColumn("_w", words(text)).withColumn("_n", F.size("_w"))
    rows = df.select(*keep, F.col(seconds).alias("_d"), "_n", F.posexplode("_w").alias("i", "word"))
    return rows.select(*keep, "i", "word", (F.col("i") * F.col("_d") / F.col("_n")).alias("t0"), ((F.col("i") + 1) * F.col("_d") / F.col("_n")).alias("t1"))


def reading_minutes(count: Column | str) -> Column:
    return F.floor(_c(count) / 250 + 0.5).cast("int")


def eta_seconds(done, total, elapsed, synth_done=None, synth_elapsed=None) -> Column:
    """Seconds to go: the rate of synthesis once it is known, else the rate of everything after three seconds."""
    d, t, e = _c(done), _c(total), _c(elapsed)
    sd = _c(synth_done) if synth_done is not None else F.lit(None)
    se = _c(synth_elapsed) if synth_elapsed is not None else F.lit(None)
    known = se.isNotNull() & (((se >= 2) & (sd >= 2)) | ((se >= 1) & (sd >= 1)))
    rate = F.when(se.isNotNull(), F.when(known, sd / se)).when(e >= 3, d / e)
    return F.when((d < t) & (rate > 0), (t - d) / rate)


def number_range(selection: Column | str, n: Column | str) -> Column:
    """'1,3,5-8' as sorted distinct numbers within 1..n; 'all' or '*' is all; anything malformed is null."""
    s = F.lower(F.regexp_replace(F.coalesce(_c(selection), F.lit("")), f"[{P.BLANKS}]+", ""))
    whole = s.isin("", "all", "*", "mind", "összes")
    ok = s.rlike("^[0-9]{1,9}(?:-[0-9]{1,9})?(?:,[0-9]{1,9}(?:-[0-9]{1,9})?)*$")
    parts = F.when(ok, F.split(s, ",")).otherwise(F.array().cast("array<string>"))
    lo = lambda p: F.try_element_at(F.split(p, "-"), F.lit(1)).cast("int")
    hi = lambda p: F.try_element_at(F.split(p, "-"), F.lit(-1)).cast("int")
    good = ok & F.forall(parts, lambda p: (lo(p) >= 1) & (hi(p) <= _c(n)) & (lo(p) <= hi(p)))
    nums = F.flatten(F.transform(parts, lambda p: F.sequence(lo(p), hi(p))))
    return F.when(whole, F.sequence(F.lit(1), _c(n))).when(good, F.array_sort(F.array_distinct(nums)))


# ---------------------------------------------------------------- small arithmetic on rows


def eta_text(seconds: Column | str) -> Column:
    """'45s', '3m 05s', '2h 07m'; '' where nothing is known. Halves round to the even second."""
    s = F.bround(_c(seconds), 0).cast("long")
    m = F.floor(s / 60)
    return (
        F.when(_c(seconds).isNull() | F.isnan(_c(seconds).cast("double")) | (_c(seconds) < 0), "")
        .when(s < 60, F.format_string("%ds", s))
        .when(m < 60, F.format_string("%dm %02ds", m, s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(m / 60), m % 60))
    )


def progress_percent(index: Column | str, n: Column | str) -> Column:
    """How far through a chapter a segment is; null for a chapter without segments."""
    return F.when(_c(n) > 0, _c(index) / _c(n) * 100)


def clamped_index(value: Column | str, n: Column | str) -> Column:
    """The number a text begins with, within 0..n-1; 0 for none."""
    lead = F.regexp_extract(F.coalesce(_c(value).cast("string"), F.lit("")), f"^[{P.BLANKS}]*([+-]?[0-9]+)", 1)
    parsed = F.coalesce(lead.try_cast("decimal(38,0)"), F.lit(0))
    return F.greatest(F.lit(0), F.least(parsed, F.greatest(F.coalesce(_c(n), F.lit(1)), F.lit(1)) - 1)).cast("long")


def clamped(value: Column | str, low, high, default) -> Column:
    """A setting within its bounds, the default where it is no number."""
    v = _c(value).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(v, F.lit(float(high)))))


def one_of(value: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    v = F.lower(strip(F.coalesce(_c(value), F.lit(default))))
    return F.when(v.isin(*allowed), v).otherwise(default)


def nearest(value: Column | str, steps: tuple[int, ...], default: int) -> Column:
    """The allowed step that is nearest to a number, the first of equals."""
    v = F.coalesce(_c(value).try_cast("int"), F.lit(default))
    return F.array_min(F.array(*[F.struct(F.abs(v - s).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(steps)]))["s"]


# Beginnings of the names of text models, and what marks models of another kind.
TEXT_MODELS, OTHER_MODELS = ("gpt-", "o1", "o3", "o4", "chatgpt-", "chat-"), ("audio", "realtime", "transcribe", "tts", "image", "search-preview")


def is_text_model(name: Column | str) -> Column:
    s = F.lower(F.coalesce(_c(name), F.lit("")))
    return s.rlike("^(?:" + "|".join(TEXT_MODELS) + ")") & ~s.rlike("|".join(OTHER_MODELS))


def text_models(names: Column | str) -> Column:
    """The distinct text models of a list, in order."""
    return F.array_sort(F.array_distinct(F.filter(_c(names), is_text_model)))


def endpoint(base: Column | str, suffix: str) -> Column:
    """The address of a call; a base that ends in it already stays; null for an empty base."""
    s = F.regexp_replace(strip(F.coalesce(_c(base), F.lit(""))), "/+$", "")
    return F.when(s == "", F.lit(None)).when(s.endswith("/" + suffix), s).otherwise(F.concat(s, F.lit("/" + suffix)))


# The accents a voice may have, and the parts of a voice that is not described.
ACCENTS = tuple(f"{x} accent" for x in ("american", "british", "australian", "canadian", "indian", "chinese", "korean", "japanese"))
PLAIN_VOICE = ("female", "young adult", "moderate pitch", "american accent")


def studio_voice(instruct: Column | str) -> Column:
    """Gender, age, pitch and accent of a description, in this order, with defaults for what it lacks.

    The first gender in the text counts; of the others the first in the order of the vocabulary.
    """
    tokens = F.filter(F.transform(F.split(F.coalesce(_c(instruct), F.lit("")), ","), lambda t: F.lower(strip(t))), lambda t: t != "")
    first = F.try_element_at(F.filter(tokens, lambda t: t.isin(*GENDERS)), F.lit(1))
    rest = [F.coalesce(*[F.when(F.array_contains(tokens, w), w) for w in words]) for words in (AGES, PITCHES, ACCENTS)]
    return F.concat_ws(", ", *[F.coalesce(x, F.lit(d)) for x, d in zip((first, *rest), PLAIN_VOICE)])


# Version and settings that are part of the second engine's keys, as they are written there.
SECOND_VERSION, SECOND_CONTROLS = 6, "('raw', 'none', 'none', 'none')"
SECOND_SAMPLING = "{'temperature': 0.8, 'top_p': 0.95, 'top_k': 50, 'max_new_tokens': 1024, 'seed': -1}"


def second_cache_key(text, instruct, ref, speed, ref_text, lang, normalize: bool = False) -> Column:
    """Digest of a rendering by the second engine; the speed has three decimals."""

    def part(x) -> Column:
        return F.coalesce(_c(x).cast("string"), F.lit("None"))

    tail = F.lit(f"nt={int(normalize)}|{SECOND_CONTROLS}|{SECOND_SAMPLING}")
    return F.md5(F.concat_ws("|", F.lit(f"higgs-v{SECOND_VERSION}"), part(text), part(instruct), part(ref), part(ref_text), F.format_string("%.3f", _c(speed)), F.coalesce(_c(lang), F.lit("")), tail))


def reference_key(path, modified_ns, size, ref_text) -> Column:
    """Digest of a reference recording: path, time and size of the file, or the path alone where there is no file."""
    said = F.coalesce(_c(ref_text), F.lit(""))
    known = F.concat_ws("|", _c(path), _c(modified_ns).cast("string"), _c(size).cast("string"), said)
    return F.when(_c(path).isNotNull(), F.md5(F.when(_c(modified_ns).isNotNull() & _c(size).isNotNull(), known).otherwise(F.concat_ws("|", _c(path), said))))


#: The mark before a reply in a worker's output; a worker with another mark names it.
REPLY_MARK = "REPLY_JSON:"


def first_object(text: str | None, mark: str = REPLY_MARK) -> str | None:
    """The first JSON object behind the mark, in compact form, whatever follows it; null without mark or object."""
    at = (text or "").find(mark)
    if at < 0:
        return None
    try:
        made, _ = json.JSONDecoder().raw_decode(text[at + len(mark) :].lstrip())
    except ValueError:
        return None
    return json.dumps(made, ensure_ascii=False, separators=(",", ":")) if isinstance(made, dict) else None


def framed_reply(text: Column | str, mark: str = REPLY_MARK) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: first_object(t, mark)), "string")(_c(text))


_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ("", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion")


def spelled(n: int) -> str:
    """An English cardinal number; numbers beyond the names of scales stay figures."""
    if n < 20:
        return _UNITS[n]
    if n < 100:
        return _TENS[n // 10 - 2] + ("-" + _UNITS[n % 10] if n % 10 else "")
    if n < 1000:
        return _UNITS[n // 100] + " hundred" + (" and " + spelled(n % 100) if n % 100 else "")
    if n >= 1000 ** len(_SCALES):
        return str(n)
    groups, k = [], 0
    while n:
        if n % 1000:
            groups.append((k, n % 1000))
        n //= 1000
        k += 1
    words = [spelled(g) + (" " + _SCALES[k] if k else "") for k, g in reversed(groups)]
    small = groups[0][0] == 0 and groups[0][1] < 100
    return ", ".join(words[:-1]) + " and " + words[-1] if small and len(words) > 1 else ", ".join(words)


_TAG = re.compile(r"\[[^\[\]]*\]")


def outside_brackets(text: str, fn) -> str:
    """The function applied to all of a text but its bracketed marks."""
    out, at = [], 0
    for m in _TAG.finditer(text):
        out += [fn(text[at : m.start()]) if m.start() > at else "", m[0]]
        at = m.end()
    return "".join([*out, fn(text[at:]) if at < len(text) else ""])


def numbers_spelled(text: Column | str, lang: Column | str) -> Column:
    """Whole numbers of English texts in words, outside bracketed marks; only texts with figures reach the batch function."""

    def run(s):
        return s.map(lambda t: outside_brackets(t, lambda x: re.sub("[0-9]+", lambda m: spelled(int(m[0])), x)) if t is not None else None)

    need = F.coalesce(_c(lang) == "en", F.lit(False)) & _c(text).rlike("[0-9]")
    return F.coalesce(F.pandas_udf(run, "string")(F.when(need, _c(text))), _c(text))


def loudness(report: Column | str) -> Column:
    """The last measurement of a mastering report as a map; null unless all of its parts are finite numbers."""
    found = F.regexp_extract_all(F.coalesce(_c(report), F.lit("")), F.lit('(?s)(\\{\\s*"input_i".*?\\})'), 1)
    m = F.from_json(F.try_element_at(found, F.lit(-1)), "map<string,string>")
    parts = ("input_i", "input_lra", "input_tp", "input_thresh", "target_offset")
    good = F.lit(True)
    for p in parts:
        v = F.lower(F.trim(F.coalesce(F.try_element_at(m, F.lit(p)), F.lit(""))))
        good = good & ~v.isin("", "inf", "-inf", "nan")
    return F.when(good, m)


# ---------------------------------------------------------------- samples of recordings


def zero_crossings(samples: Column | str) -> Column:
    """The share of neighbouring samples whose signs differ; 0 for fewer than two."""
    x = _c(samples)
    n = F.size(x)
    neg = F.transform(x, lambda v: (v < 0).cast("int"))
    pairs = F.zip_with(F.slice(neg, 1, F.greatest(n - 1, F.lit(0))), F.slice(neg, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, v: s + v) / F.greatest(n - 1, F.lit(1)))


def expanded_reference(samples: Column | str, rate: int, short: float = 2.0, target: float = 4.0) -> Column:
    """A recording shorter than ``short`` seconds repeated until it lasts ``target``; an empty one stays."""
    x = _c(samples)
    n = F.size(x)
    return F.when((n > 0) & (n < short * rate), F.flatten(F.array_repeat(x, F.ceil(F.lit(int(target * rate)) / F.greatest(n, F.lit(1))).cast("int")))).otherwise(x)


def split_lengths(total: Column | str, texts: Column | str) -> Column:
    """How many of ``total`` samples each text gets, in proportion to its characters: one at least, the last takes the rest."""
    n, weights = _c(total).cast("long"), F.transform(_c(texts), lambda t: F.greatest(F.lit(1), F.length(F.coalesce(t, F.lit("")))).cast("long"))
    whole, k = F.aggregate(weights, F.lit(0).cast("long"), lambda s, w: s + w), F.size(weights)

    def step(acc, w):
        left = (k - F.size(acc["out"]) - 1).cast("long")
        take = F.greatest(F.lit(1).cast("long"), F.least(F.bround(n * (w.cast("double") / whole), 0).cast("long"), n - acc["at"] - left))
        take = F.when(left == 0, n - acc["at"]).otherwise(take)
        return F.struct((acc["at"] + take).alias("at"), F.concat(acc["out"], F.array(take)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(weights, start, step)["out"]
