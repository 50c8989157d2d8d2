"""Batching decisions as data: greedy packs, lanes, cache partition, voice groups, timelines and subtitles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cache_split(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses)."""
    have = cached.select(key).where(F.col(key).isNotNull()).distinct()
    return wanted.join(have, key, "left_semi"), wanted.join(have, key, "left_anti")


def packs(items: DataFrame, group: list[str], order: list[str], size: str, max_items: int, max_size: int) -> DataFrame:
    """Adds pack_no: items in order fill a pack until it has ``max_items`` or the next would pass ``max_size``.

    The fold runs over the sorted rows of a partition and restarts at each group, so no group is gathered; an item over the limit is alone.
    """
    names = [*items.columns, "pack_no"]
    gi, si = [items.columns.index(g) for g in group], items.columns.index(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total, pack = None, 0, 0, 0
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                g = tuple(row[i] for i in gi)
                s = int(row[si])
                if g != now:
                    now, n, total, pack = g, 0, 0, 0
                elif n and (n >= max_items or total + s > max_size):
                    pack, n, total = pack + 1, 0, 0
                n += 1
                total += s
                out.append((*row, pack))
            yield pd.DataFrame(out, columns=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, fields + ", pack_no int")


VOICE = ("instruct", "ref_audio", "ref_text", "language", "normalize_text")


def voice_groups(items: DataFrame) -> DataFrame:
    """Adds voice, a digest of all that one batch must share; parts that are missing count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in VOICE if c in items.columns]
    return items.withColumn("voice", F.md5(F.to_json(F.array(*parts))))


def coalesced(items: DataFrame, group: list[str], order: list[str], same: list[str], text: str, most: int) -> DataFrame:
    """(group, unit_no, text, members, first): neighbours of one voice and speed joined to texts of at most ``most`` characters.

    A change of voice or an overflow begins a new unit; with ``most`` 0 every item is a unit. A fold over sorted rows, so no group is gathered.
    """
    cols = [*group, *order, *same, text]
    ng, no = len(group), len(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, voice, size, unit = None, None, 0, 0
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                g, v, t = row[:ng], row[ng + no : -1], row[-1] or ""
                v = tuple(None if x is None or x != x else x for x in v)
                if g != now:
                    now, voice, size, unit = g, v, len(t), 0
                elif most > 0 and v == voice and size + 1 + len(t) <= most:
                    size += 1 + len(t)
                else:
                    voice, size, unit = v, len(t), unit + 1
                out.append((*row[: ng + no], t, unit))
            yield pd.DataFrame(out, columns=[*group, *order, text, "unit_no"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, *order]) + f", `{text}` string, unit_no int"
    rows = items.select(*cols).repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ")
    return rows.groupBy(*group, "unit_no").agg(F.trim(body).alias("text"), F.count("*").alias("members"), F.min(order[0]).alias("first"))


# Bounds of batches, and how many items a card of so many GB takes with and without a reference recording.
MOST_ITEMS, CLONE_ITEMS, LEAST_CHARS, MOST_CHARS, CHARS_AN_ITEM = 48, 8, 500, 40_000, 400
CARDS = ((20, 8, 16), (14, 6, 12), (10, 4, 8), (7, 3, 6), (0, 2, 4))
TIGHT = ((2.0, 4), (3.5, 8), (5.0, 12))


def batch_items(wanted, clone, failed=None) -> Column:
    """How many items a batch may have; after a failure of a batch at most half as many as that had."""
    size = F.greatest(F.lit(1), F.least(_c(wanted), F.lit(MOST_ITEMS)))
    size = F.when(_c(clone), F.least(size, F.lit(CLONE_ITEMS))).otherwise(size)
    if failed is not None:
        size = F.when(_c(failed).isNull(), size).otherwise(F.least(size, F.greatest(F.lit(1), F.floor(_c(failed) / 2).cast("int"))))
    return F.greatest(F.lit(1), size)


def batch_chars(wanted, items) -> Column:
    """How many characters a batch may have: enough for its items, within bounds."""
    return F.greatest(F.lit(LEAST_CHARS), F.least(F.greatest(_c(wanted), _c(items) * CHARS_AN_ITEM), F.lit(MOST_CHARS)))


def items_of_card(free_gb, total_gb, clone) -> Column:
    """The batch size a card's memory allows, less where little of it is free."""
    size = F.coalesce(*[F.when(_c(total_gb) >= gb, F.when(_c(clone), one).otherwise(two)) for gb, one, two in CARDS], F.when(_c(clone), 2).otherwise(4))
    cut = F.coalesce(*[F.when(_c(free_gb) < gb, F.least(size, F.lit(most))) for gb, most in TIGHT], size)
    return F.greatest(F.lit(1), F.least(cut, F.lit(MOST_ITEMS)))


def parallel_lanes(items: DataFrame, group: str, order: str, size: str, ref: str, workers: int = 2, least: int = 16) -> DataFrame:
    """Adds lane and lane_no, the place in the lane; one lane unless there are workers and items enough and all have a reference recording.

    The rows keep their order column, by which results find back to their places.
    """
    able = items.groupBy(group).agg(((F.count("*") >= least) & (F.count(F.nullif(F.col(ref), F.lit(""))) == F.count("*")) & F.lit(workers >= 2)).alias("_able"))
    out = lanes(items, group, order, size).join(able, group).withColumn("lane", F.when(F.col("_able"), F.col("lane")).otherwise(0)).drop("_able")
    return out.withColumn("lane_no", F.row_number().over(Window.partitionBy(group, "lane").orderBy(order)) - 1)


def rendered(items: DataFrame, keys: list[str], order: str, text: str, call) -> DataFrame:
    """(keys, order, result, error, alone): each group rendered as one batch, and one by one where the batch fails.

    ``call`` takes a list of texts and returns as many results; a result that is missing is an error of its item. Groups are packs
    of bounded size.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        texts, alone = pdf[text].tolist(), False
        try:
            got = list(call(texts))
            if len(got) != len(texts):
                raise ValueError("results are missing")
            made = [(x, None if x is not None else "missing result") for x in got]
        except Exception:
            made, alone = [], True
            for t in texts:
                try:
                    x = list(call([t]))[0]
                    made.append((x, None if x is not None else "missing result"))
                except Exception as e:
                    made.append((None, str(e) or type(e).__name__))
        return pdf[[*keys, order]].assign(result=[x for x, _ in made], error=[e for _, e in made], alone=alone)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", result string, error string, alone boolean"
    return items.groupBy(*keys).applyInPandas(one, schema)


def prewarm_frontier(at, n, chunk: int = 12, low: int = 5) -> Column:
    """How many segments are asked for while one is played: a chunk at the start, another whenever fewer than ``low`` beyond the next are left."""
    at, n = _c(at), _c(n)
    return F.least(n, F.lit(chunk) * (F.lit(1) + F.floor((at + low + 1) / F.lit(chunk)))).cast("int")


def merged_samples(timed: DataFrame, keys: list[str], order: str, rate: int = 24_000) -> DataFrame:
    """(keys, samples): the length of the merged recording of each group: playable segments and the silence between them, a second if there are none."""
    w = Window.partitionBy(*keys).orderBy(order)
    play = timed.where("audio_path is not null")
    gap = F.when(F.lead(order).over(w).isNotNull(), F.floor(F.lit(rate) * T.pause_after("text", "ends_paragraph", "is_dialogue", F.lead("is_dialogue").over(w)))).otherwise(0)
    sums = play.select(*keys, (F.round(F.coalesce("duration_sec", F.lit(0.0)) * rate).cast("long") + gap).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("samples"))
    return timed.select(*keys).distinct().join(sums, keys, "left").withColumn("samples", F.coalesce("samples", F.lit(rate)).cast("long"))


def manifest(chapters: DataFrame, audio: str = "wav", subtitles: str = "ass") -> DataFrame:
    """Adds stem, audio_path, subtitle_path, audio_fmt, sub_fmt and track to chapters (book_id, author, book_title, number, width, title)."""
    stem = F.concat(F.lpad(F.col("number").cast("string"), F.col("width"), F.lit("0")), F.lit("_"), T.safe_name("title"))
    folder, kind = T.export_dir("author", "book_title"), "ass" if subtitles == "ass" else "srt"
    # the stem is made safe once more as a whole
    out = chapters.withColumn("stem", T.safe_name(stem)).withColumn("_f", folder)
    path = lambda ext: F.concat(F.col("_f"), F.lit("/"), F.col("stem"), F.lit("." + ext))
    return out.withColumns({"audio_path": path(audio), "subtitle_path": path(kind), "audio_fmt": F.lit(audio), "sub_fmt": F.lit(kind), "track": F.col("number")}).drop("_f")


def lanes(items: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Adds lane 0 or 1: a cut in order where the squared sizes on both sides are closest to equal; the first best cut holds."""
    w = Window.partitionBy(group).orderBy(order)
    cost = F.pow(F.greatest(F.lit(32), F.col(size)), 2).cast("long")
    rows = items.withColumn("_cost", cost).withColumn("_run", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_k", F.row_number().over(w) - 1)
    total = rows.groupBy(group).agg(F.sum("_cost").alias("_all"))
    cuts = rows.where("_k > 0").join(total, group).select(group, "_k", F.abs(F.col("_all") / 2 - F.col("_run")).alias("_d"))
    best = cuts.groupBy(group).agg(F.min(F.struct("_d", "_k")).alias("_b")).select(group, F.col("_b._k").alias("_cut"))
    out = rows.join(best, group, "left").withColumn("lane", F.when(F.col("_k") >= F.col("_cut"), 1).otherwise(0))
    return out.drop("_cost", "_run", "_k", "_cut")


def timeline(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds pause, t_start and t_end: durations and pauses added up in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = segments.withColumn("pause", T.pause_after("text", "ends_paragraph", "is_dialogue", F.lead("is_dialogue").over(w)))
    span = F.coalesce("duration_sec", F.lit(0.0))
    before = F.coalesce(F.sum(span + F.col("pause")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("t_start", before).withColumn("t_end", F.col("t_start") + span)


def srt(timed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, body): one subtitle file per group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    cue = F.format_string("%d\n%s --> %s\n%s\n", n, T.srt_time("t_start"), T.srt_time("t_end"), F.col("text"))
    cues = timed.select(*keys, n.alias("_n"), cue.alias("_c"))
    return cues.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_c"))), lambda x: x["_c"]), "\n").alias("body"))


# Head and lines of the styled subtitle format.
ASS_HEAD = (
    "[Script Info]\nTitle: %s\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: 1280\nPlayResY: 720\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Narrator,Arial,28,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,30,1\n%s\n\n[Events]\n"
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n%s"
)
ASS_STYLE = "Style: %s,Arial,28,&H00%s,&H000000FF,&H00000000,&H80000000,0,-1,0,0,100,100,0,0,1,2,1,2,10,10,30,1"


def ass_time(seconds: pd.Series) -> pd.Series:
    """Hours, minutes and seconds with hundredths, halves rounded to the even binary value."""
    return pd.Series([f"{int(s // 3600)}:{int(s % 3600 // 60):02d}:{s % 60:05.2f}" for s in seconds])


def ass(timed: DataFrame, colours: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """(keys, body): styled subtitles; ``colours`` has book_id, name, color_hex."""
    clock = F.pandas_udf(ass_time, "string")
    safe = F.replace(F.col("name"), F.lit(" "), F.lit("_"))
    styles = colours.groupBy("book_id", safe.alias("safe")).agg(F.min_by("color_hex", "name").alias("c"))
    styles = styles.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("safe", "c"))), lambda x: F.format_string(ASS_STYLE, x["safe"], T.ass_colour(x["c"]))), "\n").alias("styles"))
    known = colours.select("book_id", F.col("name").alias("character_name"), F.lit(True).alias("known")).distinct()
    rows = timed.join(known, ["book_id", "character_name"], "left")
    who = F.coalesce(F.nullif("character_name", F.lit("")), F.lit("Narrator"))
    style = F.when(F.col("known"), F.replace(who, F.lit(" "), F.lit("_"))).otherwise("Narrator")
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\\N"))
    body = F.when(F.coalesce("is_dialogue", F.lit(0)) != 0, F.concat(F.lit("{\\i1}"), body, F.lit("{\\i0}"))).otherwise(body)
    line = F.format_string("Dialogue: 0,%s,%s,%s,%s,0000,0000,0000,,%s", clock("t_start"), clock("t_end"), style, who, body)
    events = rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("events"))
    out = events.join(styles, "book_id", "left")
    return out.select(*keys, F.format_string(ASS_HEAD, F.lit(title), F.coalesce("styles", F.lit("")), "events").alias("body"))


def speaker_runs(units: DataFrame, keys: list[str], order: str, who: str) -> DataFrame:
    """(keys, run, speaker, first, last, units): runs of one speaker."""
    w = Window.partitionBy(*keys).orderBy(order)
    flag = ~F.col(who).eqNullSafe(F.lag(who).over(w)) | (F.row_number().over(w) == 1)
    rows = units.withColumn("_f", flag.cast("int")).withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy(*keys, "run").agg(F.min_by(who, order).alias("speaker"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("units"))


def synthesize(df: DataFrame, text: str, speed: str, model=None) -> DataFrame:
    """Adds duration_sec with a batch function, one model per worker; the built-in stand-in takes 0.4 s a word."""
    def run(it):
        call = model() if model else (lambda t, v: [round(0.4 * len((x or "").split()) / max(s or 1.0, 0.1), 2) for x, s in zip(t, v)])
        for t, v in it:
            yield pd.Series(call(t, v))

    fn = F.pandas_udf("double", F.PandasUDFType.SCALAR_ITER)(run)
    return df.withColumn("duration_sec", fn(text, speed))
