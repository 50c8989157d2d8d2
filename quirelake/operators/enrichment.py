"""From chapters to the segments that are spoken: units by the book's mode, speakers, tags, speeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import segmentation as G
from . import speakers as S

# The narrator of books that name none.
NARRATOR = "male, elderly, low pitch, british accent"
_UNITS = "pos int, unit_index int, text string, speaker_candidate boolean, turn_index int, ends_paragraph boolean, quoted_by string"


def units_of(text: str, title: str, mode: str) -> list[tuple]:
    """(unit index, text, candidate, turn, ends paragraph, speaker named beside the quotation) of one chapter.

    Modes: 'single' narrator, 'plain' (no annotations: speakers are guessed), 'annotated'. Long units come in pieces; the last one ends the paragraph.
    """
    clean = G.normalise(text).strip()
    if mode == "annotated":
        units = [(i, t, c, turn, end) for i, t, c, turn, _, end in G.speaker_units(clean)]
    else:
        made = G.single_narrator_units(clean, title) if mode == "single" else G.default_units(clean, title)
        units = [(None, t, G.has_dialogue(t), None, end) for t, end in made]
    said = S.dialogue_map(clean) if mode == "plain" else {}
    out = []
    for i, t, candidate, turn, end in units:
        pieces = G.bounded(t)
        for k, p in enumerate(pieces):
            who = S.speaker_of(p, said) if said and G.has_dialogue(p) else None
            out.append((i, p, candidate, turn, end and k == len(pieces) - 1, who))
    return out


def enrich(chapters: DataFrame, books: DataFrame, characters: DataFrame, annotations: DataFrame) -> DataFrame:
    """(book_id, chapter_id, segment_index, text, enriched_text, character_name, instruct, speed, is_dialogue, is_whisper, unit_index, speaker_candidate, ends_paragraph).

    ``chapters`` has chapter_id, book_id, title, content; ``books`` book_id, narrator_instruct, single_narrator_mode; ``characters`` book_id, name,
    instruct; ``annotations`` chapter_id, unit_index, speaker_name, one row a unit. A chapter with annotations takes its speakers
    from them, filled up within turns; a name that is not in the cast counts as dialogue without a voice. Null and empty chapters have no segments.
    """
    has = annotations.select("chapter_id").distinct().withColumn("_a", F.lit(True))
    base = chapters.where(F.col("content").isNotNull()).select("chapter_id", "book_id", F.coalesce("title", F.lit("")).alias("title"), "content")
    base = base.join(books.select("book_id", F.coalesce("narrator_instruct", F.lit(NARRATOR)).alias("narrator"), (F.coalesce("single_narrator_mode", F.lit(0)) != 0).alias("single")), "book_id", "left").join(has, "chapter_id", "left")
    mode = F.when(F.col("single"), "single").when(F.col("_a"), "annotated").otherwise("plain")
    # in the order of the book's whole text
    base = base.withColumn("mode", mode).withColumn("scene", T.scene_speed(T.normalise("content"))).withColumn("narrator", F.coalesce("narrator", F.lit(NARRATOR)))

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    keep = ["book_id", "chapter_id", "mode", "narrator", "scene"]
    names = [*keep, "pos", "unit_index", "text", "speaker_candidate", "turn_index", "ends_paragraph", "quoted_by"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:5], k, *u) for r in b.itertuples(index=False, name=None) for k, u in enumerate(units_of(r[6], r[5], r[2]))]
            yield pd.DataFrame(rows, columns=names).astype({"unit_index": "Int32", "turn_index": "Int32"})

    units = base.select(*keep, "title", "content").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + _UNITS)
    units = units.join(annotations.select("chapter_id", "unit_index", "speaker_name"), ["chapter_id", "unit_index"], "left")
    units = S.expand_turns(units)
    named = F.nullif(F.when(F.col("mode") == "annotated", F.col("effective_speaker")).when(F.col("mode") == "plain", F.col("quoted_by")), F.lit(""))
    units = units.withColumn("named", named)
    units = units.withColumn("is_dialogue", F.when(F.col("mode") == "annotated", F.col("named").isNotNull()).otherwise(T.has_dialogue("text")))
    cast = characters.select("book_id", F.col("name").alias("named"), F.lit(True).alias("known"), F.col("instruct").alias("voice")).dropDuplicates(["book_id", "named"])
    rows = units.join(cast, ["book_id", "named"], "left")
    speaker = F.when(F.col("known"), F.col("named"))
    base_voice = F.when(speaker.isNotNull(), F.coalesce("voice", "narrator")).otherwise(F.col("narrator"))
    whisper = F.col("text").rlike(T.P.WHISPER)
    add = whisper & (speaker.isNotNull() | (F.col("mode") == "single")) & ~base_voice.contains("whisper")
    rows = rows.withColumns({"character_name": speaker, "instruct": F.when(add, F.concat(base_voice, F.lit(", whisper"))).otherwise(base_voice), "is_whisper": whisper})
    rows = T.with_tag(rows, "text", F.col("is_dialogue"))
    rows = rows.withColumns({"enriched_text": T.inject_tag("text", "tag"), "speed": T.segment_speed("text", "scene", "is_dialogue", "tag")})
    index = F.row_number().over(Window.partitionBy("chapter_id").orderBy("pos")) - 1
    return rows.select(
        "book_id", "chapter_id", index.alias("segment_index"), "text", "enriched_text", "character_name", "instruct", "speed",
        F.col("is_dialogue").cast("int").alias("is_dialogue"), F.col("is_whisper").cast("int").alias("is_whisper"), "unit_index",
        F.col("speaker_candidate").cast("int").alias("speaker_candidate"), F.col("ends_paragraph").cast("int").alias("ends_paragraph"),
    )


#: What a stored segment is compared by with one made anew.
COMPARED = ("text", "enriched_text", "character_name", "instruct", "speed", "is_dialogue", "unit_index", "speaker_candidate", "ends_paragraph")


def comparable(segments: DataFrame) -> DataFrame:
    """The compared columns in one form: empty is null, flags are 0 or 1, the speed has two decimals."""
    flag = lambda c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0).cast("int")
    return segments.withColumns({
        "character_name": F.nullif("character_name", F.lit("")), "instruct": F.nullif("instruct", F.lit("")), "speed": F.round(F.coalesce(F.nullif("speed", F.lit(0.0)), F.lit(1.0)), 2),
        "is_dialogue": flag("is_dialogue"), "speaker_candidate": flag("speaker_candidate"), "ends_paragraph": flag("ends_paragraph"),
    })
