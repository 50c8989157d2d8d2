"""The library's queries over whole tables, each beside the SQL it is checked against (where SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import schedule as C
from ..operators import segmentation as G
from ..operators import speakers as S
from ..operators import store as R
from ..session import spread, table

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _ALL[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401  adds its queries to these

    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) if queries() else {}


# ---------------------------------------------------------------- shared SQL

_B = P.BLANKS
_LETTERS_UP, _LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(pattern: str) -> str:
    """A pattern as a literal of the checking engine: flags it lacks are dropped, quotes doubled."""
    return "'" + pattern.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[{_B}]+'), lambda w: w <> '')"


_PROGRESS = "SELECT book_id, chapter_id, segment_index, created_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) AS n FROM bookmarks) WHERE n = 1"
_SEGMENTS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS n FROM tts_segments) WHERE n = 1"


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    """The place last bookmarked in each book."""
    rows = table(spark, sf, "bookmarks", "id", "book_id", "chapter_id", "segment_index", "created_at")
    return R.latest(rows, ["book_id"], [F.desc("created_at"), F.desc("id")]).drop("id")


def _segments(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Segments delivered twice count once."""
    return table(spark, sf, "tts_segments", *cols).dropDuplicates(["id"])


# ---------------------------------------------------------------- relational store


@query(f"""
WITH p AS ({_PROGRESS})
SELECT b.id, b.title, b.author, b.last_read, b.added_at, p.chapter_id, c.title AS chapter_title, coalesce(b.last_read, b.added_at) AS recent
FROM books b LEFT JOIN p ON p.book_id = b.id LEFT JOIN chapters c ON c.id = p.chapter_id
""")
def r2_library_listing(spark, sf):
    """Books with the chapter they were left at, most recent first."""
    books = table(spark, sf, "books", "id", "title", "author", "last_read", "added_at")
    p = _progress(spark, sf).select(F.col("book_id").alias("id"), "chapter_id")
    c = table(spark, sf, "chapters", "id", "title").toDF("chapter_id", "chapter_title")
    out = books.join(p, "id", "left").join(c, "chapter_id", "left").withColumn("recent", F.coalesce("last_read", "added_at"))
    return out.select("id", "title", "author", "last_read", "added_at", "chapter_id", "chapter_title", "recent").orderBy(F.desc("recent"), F.desc("added_at"), "id")


@query("""
SELECT c.id, c.book_id, c.title, c.order_num, CAST(count(s.id) AS BIGINT) AS segments, CAST(coalesce(sum(CASE WHEN s.audio_path IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS ready
FROM chapters c LEFT JOIN tts_segments s ON s.chapter_id = c.id GROUP BY c.id, c.book_id, c.title, c.order_num
""")
def r3_chapter_segment_counts(spark, sf):
    """Segments and rendered segments of each chapter; segments are counted before the join."""
    s = table(spark, sf, "tts_segments", "chapter_id", "audio_path").groupBy(F.col("chapter_id").alias("id")).agg(F.count("*").alias("segments"), F.count("audio_path").alias("ready"))
    return table(spark, sf, "chapters", "id", "book_id", "title", "order_num").join(s, "id", "left").fillna(0, ["segments", "ready"])


@query("""
SELECT b.id, b.title, (SELECT count(*) FROM characters c WHERE c.book_id = b.id) AS cast_size, (SELECT count(*) FROM speaker_annotations a WHERE a.book_id = b.id) AS annotations FROM books b
""")
def r4_book_counts(spark, sf):
    out = table(spark, sf, "books", "id", "title")
    for name, col in (("characters", "cast_size"), ("speaker_annotations", "annotations")):
        out = out.join(table(spark, sf, name, "book_id").groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias(col)), "id", "left")
    return out.fillna(0, ["cast_size", "annotations"])


@query("SELECT m.id, m.book_id, m.chapter_id, c.title AS chapter_title, m.label, m.created_at FROM bookmarks m JOIN chapters c ON c.id = m.chapter_id")
def r5_bookmark_listing(spark, sf):
    m = table(spark, sf, "bookmarks", "id", "book_id", "chapter_id", "label", "created_at")
    return m.join(table(spark, sf, "chapters", "id", "title").toDF("chapter_id", "chapter_title"), "chapter_id").orderBy(F.desc("created_at"), "id")


@query(f"""
WITH p AS ({_PROGRESS}) SELECT p.book_id, c.id AS chapter_id, c.title, c.order_num FROM p JOIN chapters c ON c.id = p.chapter_id AND c.book_id = p.book_id
""")
def r6_progress_chapter(spark, sf):
    c = table(spark, sf, "chapters", "id", "book_id", "title", "order_num").withColumnRenamed("id", "chapter_id")
    return _progress(spark, sf).select("book_id", "chapter_id").join(c, ["chapter_id", "book_id"])


@query(f"""
WITH p AS ({_PROGRESS}), saved AS (SELECT c.book_id, c.id AS chapter_id, 0 AS prio, c.order_num FROM p JOIN chapters c ON c.id = p.chapter_id AND c.book_id = p.book_id),
u AS (SELECT * FROM saved UNION ALL SELECT book_id, id, 1, order_num FROM chapters)
SELECT book_id, chapter_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY prio, order_num, chapter_id) AS n FROM u) WHERE n = 1
""")
def r7_resume_chapter(spark, sf):
    """Where reading goes on: the saved chapter, else the first."""
    c = table(spark, sf, "chapters", "id", "book_id", "order_num").withColumnRenamed("id", "chapter_id")
    saved = c.join(_progress(spark, sf).select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi")
    return R.first_by_priority([saved, c], ["book_id"], ["order_num", "chapter_id"]).select("book_id", "chapter_id")


@query("SELECT id, book_id, name, frequency FROM characters")
def r11_cast_by_frequency(spark, sf):
    return table(spark, sf, "characters", "id", "book_id", "name", "frequency").orderBy("book_id", F.desc("frequency"), "name")


@query("""
SELECT DISTINCT s.chapter_id, k.id AS character_id FROM characters k JOIN (SELECT DISTINCT book_id, chapter_id, lower(character_name) AS w FROM tts_segments WHERE character_name IS NOT NULL) s ON s.book_id = k.book_id AND s.w = lower(k.name)
""")
def r12_chapter_cast(spark, sf):
    """The characters that speak in each chapter."""
    s = table(spark, sf, "tts_segments", "book_id", "chapter_id", F.lower("character_name").alias("w")).where("w is not null").distinct()
    k = table(spark, sf, "characters", F.col("id").alias("character_id"), "book_id", F.lower("name").alias("w"))
    return k.join(s, ["book_id", "w"]).select("chapter_id", "character_id").distinct()


_ANN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, unit_index ORDER BY id DESC) AS n FROM speaker_annotations) WHERE n = 1"


def _annotations(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The last analysis of each unit."""
    rows = table(spark, sf, "speaker_annotations", *dict.fromkeys(["id", "chapter_id", "unit_index", *cols]))
    return R.latest(rows, ["chapter_id", "unit_index"], [F.desc("id")])


@query(f"""
WITH a AS ({_ANN}), s AS ({_SEGMENTS})
SELECT s.id, s.chapter_id, s.segment_index, a.speaker_name, a.source, k.id AS character_id FROM s LEFT JOIN a ON a.chapter_id = s.chapter_id AND a.unit_index = s.unit_index
LEFT JOIN characters k ON k.book_id = s.book_id AND k.name = s.character_name
""")
def r13_segment_metadata(spark, sf):
    """Segments with the annotation of their unit and the character that speaks."""
    s = _segments(spark, sf, "id", "book_id", "chapter_id", "segment_index", "unit_index", "character_name")
    a = _annotations(spark, sf, "speaker_name", "source").drop("id")
    k = table(spark, sf, "characters", F.col("id").alias("character_id"), "book_id", F.col("name").alias("character_name"))
    return s.join(a, ["chapter_id", "unit_index"], "left").join(k, ["book_id", "character_name"], "left").select("id", "chapter_id", "segment_index", "speaker_name", "source", "character_id")


@query("""
SELECT 'annotation' AS what, id FROM speaker_annotations WHERE coalesce(source, 'automatic') = 'manual'
UNION ALL SELECT 'character', k.id FROM characters k WHERE EXISTS (SELECT 1 FROM speaker_annotations a WHERE a.book_id = k.book_id AND a.source = 'manual' AND a.speaker_name <> '' AND a.speaker_name = k.name)
""")
def r14_kept_by_reanalysis(spark, sf):
    """What a new analysis leaves: manual annotations and the characters they name."""
    manual = table(spark, sf, "speaker_annotations", "id", "book_id", "source", "speaker_name").where(F.coalesce("source", F.lit("automatic")) == "manual")
    named = manual.where("speaker_name <> ''").select("book_id", F.col("speaker_name").alias("name"))
    kept = table(spark, sf, "characters", "id", "book_id", "name").join(named, ["book_id", "name"], "left_semi")
    return manual.select(F.lit("annotation").alias("what"), "id").unionByName(kept.select(F.lit("character").alias("what"), "id"))


@query("""
WITH new AS (SELECT DISTINCT book_id, speaker_name AS name FROM speaker_annotations WHERE speaker_name NOT IN ('', 'Narrator', 'Unknown'))
SELECT book_id, name, true AS known FROM characters UNION ALL SELECT n.book_id, n.name, false FROM new n WHERE NOT EXISTS (SELECT 1 FROM characters c WHERE c.book_id = n.book_id AND c.name = n.name)
""")
def r16_insert_or_ignore(spark, sf):
    """Speakers join the cast unless they are in it."""
    old = table(spark, sf, "characters", "book_id", "name").withColumn("known", F.lit(True))
    new = table(spark, sf, "speaker_annotations", "book_id", F.col("speaker_name").alias("name")).where("name not in ('', 'Narrator', 'Unknown')").distinct().withColumn("known", F.lit(False))
    return R.insert_or_ignore(old, new, ["book_id", "name"], [F.col("name")])


_FOLD = f"translate({{0}}, '{_LETTERS_UP}', '{_LETTERS_LOW}')"


@query(f"""
SELECT k.id, k.book_id, k.name, CAST((SELECT count(*) FROM speaker_annotations a WHERE a.book_id = k.book_id AND {_FOLD.format('a.speaker_name')} = {_FOLD.format('k.name')}) AS INTEGER) AS frequency FROM characters k
""")
def r17_frequency_recount(spark, sf):
    return S.recount(table(spark, sf, "characters", "id", "book_id", "name"), table(spark, sf, "speaker_annotations", "book_id", "speaker_name"))


@query("""
WITH new AS (SELECT book_id, chapter_id, segment_index AS position, created_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) AS n FROM bookmarks) WHERE n = 1)
SELECT c.book_id, coalesce(n.chapter_id, c.id) AS chapter_id, coalesce(n.position, 0) AS position FROM chapters c LEFT JOIN new n ON n.book_id = c.book_id WHERE c.order_num = 0
""")
def r18_progress_upsert(spark, sf):
    """Progress starts at the first chapter; bookmarks move it."""
    start = table(spark, sf, "chapters", "book_id", F.col("id").alias("chapter_id"), "order_num").where("order_num = 0").select("book_id", "chapter_id", F.lit(0).alias("position"))
    new = _progress(spark, sf).select("book_id", "chapter_id", F.col("segment_index").alias("position"))
    return R.upsert(start, new.join(start.select("book_id"), "book_id", "left_semi"), ["book_id"])


@query("SELECT s.id, s.chapter_id, s.segment_index FROM tts_segments s WHERE s.book_id NOT IN (SELECT id FROM books WHERE narrator_instruct IS NULL)")
def r19_segments_with_narrator(spark, sf):
    """A changed default narrator drops the segments of the books that use it."""
    doomed = table(spark, sf, "books", F.col("id").alias("book_id"), "narrator_instruct").where("narrator_instruct is null")
    return R.delete_where_in(table(spark, sf, "tts_segments", "id", "book_id", "chapter_id", "segment_index"), doomed, ["book_id"]).select("id", "chapter_id", "segment_index")


_TWICE = "SELECT id AS book_id FROM (SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY id) AS n FROM books) WHERE n > 1"


@query(f"""
WITH d AS ({_TWICE}) SELECT 'chapters' AS tab, count(*) AS kept FROM chapters WHERE book_id NOT IN (SELECT book_id FROM d) UNION ALL
SELECT 'characters', count(*) FROM characters WHERE book_id NOT IN (SELECT book_id FROM d) UNION ALL SELECT 'bookmarks', count(*) FROM bookmarks WHERE book_id NOT IN (SELECT book_id FROM d)
UNION ALL SELECT 'speaker_annotations', count(*) FROM speaker_annotations WHERE book_id NOT IN (SELECT book_id FROM d) UNION ALL SELECT 'tts_segments', count(*) FROM tts_segments WHERE book_id NOT IN (SELECT book_id FROM d)
""")
def r20_cascade_delete(spark, sf):
    """Rows left in each table when second imports of a file are removed."""
    w = Window.partitionBy("file_path").orderBy("id")
    doomed = table(spark, sf, "books", "id", "file_path").withColumn("n", F.row_number().over(w)).where("n > 1").select(F.col("id").alias("book_id"))
    kids = {n: table(spark, sf, n, "book_id") for n in ("chapters", "characters", "bookmarks", "speaker_annotations", "tts_segments")}
    out = None
    for name, df in R.cascade(doomed, kids, "book_id").items():
        part = df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("tab"), "kept")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH s AS ({_SEGMENTS}) SELECT id, CASE WHEN audio_path IS NULL THEN '/cache/' || substr(cache_key, 1, 2) || '/' || cache_key || '.wav' ELSE audio_path END AS audio_path FROM s WHERE cache_key IS NOT NULL
""")
def r22_batched_update(spark, sf):
    """Pointers to rendered audio are set in one pass."""
    s = _segments(spark, sf, "id", "audio_path", "cache_key").where("cache_key is not null")
    new = s.where("audio_path is null").select("id", F.concat(F.lit("/cache/"), F.substring("cache_key", 1, 2), F.lit("/"), F.col("cache_key"), F.lit(".wav")).alias("audio_path"))
    return R.changed(s, new, ["id"], ["audio_path"]).select("id", "audio_path")


_NINE = ("text", "enriched_text", "character_name", "instruct", "speed", "is_dialogue", "unit_index", "speaker_candidate", "ends_paragraph")
_MADE = {
    "text": "trim(text)", "enriched_text": "text", "character_name": "nullif(character_name, '')", "instruct": "coalesce(instruct, 'male')", "speed": "round(coalesce(speed, 1.0), 1)",
    "is_dialogue": "CASE WHEN character_name IS NULL THEN 0 ELSE 1 END", "unit_index": "segment_index", "speaker_candidate": "0", "ends_paragraph": "CASE WHEN segment_index % 3 = 2 THEN 1 ELSE 0 END",
}


@query(f"""
WITH s AS ({_SEGMENTS}), n AS (SELECT chapter_id, segment_index, {', '.join(f'{v} AS {k}' for k, v in _MADE.items())} FROM s WHERE segment_index % 11 <> 10 OR segment_index < 10)
SELECT s.chapter_id, count(*) AS mismatches FROM s LEFT JOIN n ON n.chapter_id = s.chapter_id AND n.segment_index = s.segment_index
WHERE n.segment_index IS NULL OR {' OR '.join(f's.{c} IS DISTINCT FROM n.{c}' for c in _NINE)} GROUP BY s.chapter_id
""")
def r23_stale_chapters(spark, sf):
    """Chapters whose stored segments differ from others in any of nine columns, or in number, by place in the chapter."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", *_NINE)
    made = s.where("segment_index % 11 <> 10 or segment_index < 10").select("chapter_id", "segment_index", *[F.expr(v).alias(k) for k, v in _MADE.items()])
    return R.stale_keys(s, made, ["chapter_id"], "segment_index", list(_NINE))


@query("SELECT id, substr(coalesce(text_excerpt, ''), 1, 200) AS excerpt FROM bookmarks")
def r25_bookmark_excerpts(spark, sf):
    return table(spark, sf, "bookmarks", "id", F.substring(F.coalesce("text_excerpt", F.lit("")), 1, 200).alias("excerpt"))


@query("SELECT book_id, md5(string_agg(content, ' ' ORDER BY order_num, id)) AS digest, CAST(sum(length(content)) AS BIGINT) AS chars FROM chapters GROUP BY book_id")
def r26_full_text(spark, sf):
    """The text of each book, in order, as digest and length."""
    c = table(spark, sf, "chapters", "id", "book_id", "order_num", "content")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("order_num", "id", "content")))), lambda x: x["content"]), " ")
    return c.groupBy("book_id").agg(F.md5(body).alias("digest"), F.sum(F.length("content")).alias("chars"))


@query("SELECT book_id, replace(name, ' ', '_') AS safe, min_by(color_hex, id) AS color_hex FROM characters GROUP BY 1, 2")
def r27_styles(spark, sf):
    k = table(spark, sf, "characters", "id", "book_id", "name", "color_hex")
    return k.groupBy("book_id", F.replace(F.col("name"), F.lit(" "), F.lit("_")).alias("safe")).agg(F.min_by("color_hex", "id").alias("color_hex"))


@query("SELECT id, book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY order_num, id) AS INTEGER) AS chapter_number FROM chapters")
def r28_chapter_numbers(spark, sf):
    return table(spark, sf, "chapters", "id", "book_id", "order_num").select("id", "book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("order_num", "id")).alias("chapter_number"))


@query("""
WITH f AS (SELECT DISTINCT audio_path FROM tts_segments WHERE audio_path LIKE '%.wav' AND length(cache_key) = 32)
SELECT s.chapter_id, count(*) AS segments, count(f.audio_path) AS on_disk FROM tts_segments s LEFT JOIN f ON f.audio_path = s.audio_path GROUP BY s.chapter_id
""")
def r29_audio_on_disk(spark, sf):
    """Segments whose file is in a listing of the cache folder."""
    s = table(spark, sf, "tts_segments", "chapter_id", "audio_path", "cache_key")
    files = s.where("audio_path like '%.wav' and length(cache_key) = 32").select("audio_path").distinct().withColumn("there", F.lit(1))
    return s.join(files, "audio_path", "left").groupBy("chapter_id").agg(F.count("*").alias("segments"), F.count("there").alias("on_disk"))


# ---------------------------------------------------------------- scalar functions

_SECTION_SQL = (
    "CASE " + " ".join(f"WHEN regexp_matches({_sql_strip('title')}, '(?i)^\\s*{n}\\b') THEN '{n}'" for n in P.NAMED_SECTIONS)
    + f" WHEN regexp_matches({_sql_strip('title')}, {_q(P.PART)}) THEN 'part' ELSE 'chapter' END"
)


@query(f"SELECT id, {_SECTION_SQL} AS section FROM chapters")
def t2_section_types(spark, sf):
    return table(spark, sf, "chapters", "id", "title").select("id", T.section_type("title").alias("section"))


def _sql_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""
WITH w AS (SELECT id, regexp_extract_all(lower(substr(coalesce(content, ''), 1, 100000)), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS ws, lower(substr(coalesce(content, ''), 1, 100000)) AS t FROM chapters),
n AS (SELECT id, len(list_filter(ws, lambda x: x IN {_sql_in(P.HUNGARIAN)})) + 2 * (length(t) - length(translate(t, 'őű', ''))) AS hu, len(list_filter(ws, lambda x: x IN {_sql_in(P.ENGLISH)})) AS en FROM w)
SELECT id, CAST(hu AS INTEGER) AS hu, CAST(en AS INTEGER) AS en, CASE WHEN hu >= 5 AND hu > en * 1.2 THEN 'hu' ELSE 'en' END AS lang FROM n
""")
def t4_language_scores(spark, sf):
    return T.with_language(spread(table(spark, sf, "chapters", "id", "content"), "id"), "content").select("id", "hu", "en", "lang")


@query(f"SELECT id, CAST(len({_sql_words('content')}) AS INTEGER) AS words, CAST(length(content) AS INTEGER) AS chars FROM chapters")
def t5_word_counts(spark, sf):
    return table(spark, sf, "chapters", "id", "content").select("id", T.word_count("content").alias("words"), F.length("content").alias("chars"))


@query("SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM chapters")
def t6_title_keys(spark, sf):
    return table(spark, sf, "chapters", "id", "title").select("id", T.title_key("title").alias("title_key"))


@query(f"""
SELECT id, md5(regexp_replace(translate(regexp_replace(coalesce(content, ''), '\\r\\n?', chr(10), 'g'), '\xa0​﻿�', ' '), '{P.CONTROL}', ' ', 'g')) AS digest FROM chapters
""")
def t1_normalised(spark, sf):
    """All of the normaliser but composition, which the checking engine lacks (t1_composed has it)."""
    return table(spark, sf, "chapters", "id", "content").select("id", F.md5(T.normalise("content", compose=False)).alias("digest"))


_DIALOGUE_SQL = f"(regexp_matches(coalesce({{0}}, ''), {_q(P.PAIRED_QUOTE)}) OR regexp_matches(coalesce({{0}}, ''), {_q(P.DASH_SPEECH)}))"


@query(f"SELECT id, {_DIALOGUE_SQL.replace('{0}', 'unit_text')} AS dialogue, nullif(regexp_extract(unit_text, '({P.PAIRED_QUOTE})', 1), '') AS quote FROM speaker_annotations")
def t9_dialogue_flags(spark, sf):
    a = table(spark, sf, "speaker_annotations", "id", "unit_text")
    return a.select("id", T.has_dialogue("unit_text").alias("dialogue"), F.nullif(F.regexp_extract("unit_text", f"({P.PAIRED_QUOTE})", 1), F.lit("")).alias("quote"))


_TAG_SQL = "CASE " + " ".join(f"WHEN regexp_matches(ev, {_q(p)}) THEN '{t}'" for p, t in P.TAGS[:3]) + " END"
_SPEED_SQL = f"CASE WHEN len(regexp_extract_all(x, {_q(P.ACTION)})) >= 3 THEN 1.15 WHEN len(regexp_extract_all(x, {_q(P.SLOW)})) >= 2 THEN 0.9 ELSE 1.0 END"


@query(f"""
WITH a AS (SELECT id, unit_text AS x, {_DIALOGUE_SQL.replace('{0}', 'unit_text')} AS d FROM speaker_annotations),
b AS (SELECT *, regexp_extract(x, '({P.PAIRED_QUOTE})', 1) AS q FROM a),
e AS (SELECT id, x, d, CASE WHEN q <> '' THEN concat_ws(' ', nullif(trim(substr(q, 2, length(q) - 2)), ''), nullif(trim(substr(x, 1, instr(x, q) - 1), ' ,.-'), ''), nullif(trim(substr(x, instr(x, q) + length(q)), ' ,.-'), '')) ELSE trim(x) END AS ev FROM b),
t AS (SELECT id, x, d, CASE WHEN d THEN {_TAG_SQL} END AS tag, {_SPEED_SQL} AS base FROM e),
s AS (SELECT id, x, tag, base, CASE WHEN regexp_matches(x, {_q(P.WHISPER)}) OR tag = '[sigh]' THEN least(v, 0.94) WHEN tag = '[dissatisfaction-hnn]' THEN least(v, 0.97) WHEN tag = '[laughter]' AND d THEN greatest(v, 1.03) ELSE v END AS v
  FROM (SELECT *, CASE WHEN d THEN base ELSE least(base, 1.05) END AS v FROM t))
SELECT id, tag, CAST(base AS DOUBLE) AS scene_speed, CAST(round(CASE WHEN x LIKE '%...%' OR x LIKE '% -- %' OR x LIKE '%;%' OR x LIKE '%:%' THEN least(v, 0.98) ELSE v END, 2) AS DOUBLE) AS speed FROM s
""")
def t12_tags_and_speeds(spark, sf):
    """Expression tag, scene speed and speed of every unit."""
    a = table(spark, sf, "speaker_annotations", "id", "unit_text").withColumn("d", T.has_dialogue("unit_text"))
    a = T.with_tag(a, "unit_text", F.col("d")).withColumn("scene_speed", T.scene_speed("unit_text"))
    return a.select("id", "tag", "scene_speed", T.segment_speed("unit_text", "scene_speed", "d", "tag").alias("speed"))


_PLAIN_EV = "trim(regexp_replace(regexp_replace(lower(ev), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
_ASSENT_SQL = "('yes', 'yeah', 'yep', 'yup', 'okay', 'ok', 'sure', 'right', 'indeed', 'exactly', 'correct', 'of course', 'certainly', 'i know', 'i see', 'all right')"
_ALL_TAGS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(ev, {_q(p)}) THEN '{t}'" for p, t in P.TAGS[:3]) + f" WHEN regexp_matches(ev, {_q(P.TAGS[3][0])}) AND {_PLAIN_EV} IN {_ASSENT_SQL} THEN '[confirmation-en]' END"


@query(f"""
WITH b AS (SELECT id, text AS x, coalesce(is_dialogue, 0) <> 0 AS d, regexp_extract({_sql_strip("coalesce(text, '')")}, '({P.PAIRED_QUOTE})', 1) AS q, {_sql_strip("coalesce(text, '')")} AS st FROM ({_SEGMENTS})),
e AS (SELECT *, CASE WHEN q <> '' THEN concat_ws(' ', nullif({_sql_strip("substr(q, 2, length(q) - 2)")}, ''), nullif(trim(substr(st, 1, instr(st, q) - 1), ' ,.-'), ''), nullif(trim(substr(st, instr(st, q) + length(q)), ' ,.-'), '')) ELSE st END AS ev FROM b),
t AS (SELECT *, CASE WHEN d THEN {_ALL_TAGS_SQL} END AS tag, regexp_extract(x, '({P.PAIRED_QUOTE})', 1) AS f FROM e)
SELECT id, CASE WHEN tag IS NULL THEN x WHEN f <> '' THEN substr(x, 1, instr(x, f)) || tag || ' ' || {_sql_strip("substr(f, 2, length(f) - 2)")} || substr(x, instr(x, f) + length(f) - 1) ELSE {_sql_strip("tag || ' ' || x")} END AS enriched_text FROM t
""")
def t13_tagged_text(spark, sf):
    """The segments' text with the tag put where it belongs."""
    s = T.with_tag(_segments(spark, sf, "id", "text", "is_dialogue"), "text", F.coalesce("is_dialogue", F.lit(0)) != 0)
    return s.select("id", T.inject_tag("text", "tag").alias("enriched_text"))


@query(f"""
SELECT id, CASE WHEN instruct <> '' AND regexp_matches(text, {_q(P.WHISPER)}) AND NOT contains(lower(instruct), 'whisper') THEN instruct || ', whisper' ELSE instruct END AS instruct FROM ({_SEGMENTS})
""")
def t16_whisper_instruct(spark, sf):
    return _segments(spark, sf, "id", "text", "instruct").select("id", T.whisper_instruct("instruct", "text").alias("instruct"))


_FIRST = f"lower(list_extract({_sql_words('name')}, 1))"


@query(f"SELECT id, CASE WHEN {_FIRST} IN {_sql_in(S.MALE)} THEN 'male' WHEN {_FIRST} IN {_sql_in(S.FEMALE)} THEN 'female' ELSE 'unknown' END AS gender FROM characters")
def t17_gender_by_name(spark, sf):
    return table(spark, sf, "characters", "id", "name").select("id", S.gender_by_name("name").alias("gender"))


@query(r"""
WITH s AS (SELECT book_id, unnest(string_split_regex(regexp_replace(coalesce(content, ''), '([.!?])[BLANKS]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM chapters),
c AS (SELECT book_id, s, len(list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}_]+'), lambda w: w IN ('he', 'him', 'his'))) AS he, len(list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}_]+'), lambda w: w IN ('she', 'her', 'hers'))) AS she FROM s),
n AS (SELECT DISTINCT book_id, name, list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')[1] AS f FROM characters WHERE trim(name) <> ''),
g AS (SELECT n.book_id, n.name, coalesce(sum(c.he), 0) AS male, coalesce(sum(c.she), 0) AS female FROM n LEFT JOIN c ON c.book_id = n.book_id AND c.he + c.she > 0 AND contains(c.s, n.f) GROUP BY 1, 2)
SELECT book_id, name, CAST(male AS BIGINT) AS male, CAST(female AS BIGINT) AS female, CASE WHEN male > female THEN 'male' WHEN female > male THEN 'female' ELSE 'unknown' END AS gender FROM g
""".replace("BLANKS", _B))
def t18_gender_by_pronouns(spark, sf):
    """Pronouns of the sentences that name a character."""
    names = table(spark, sf, "characters", "book_id", "name")
    texts = spread(table(spark, sf, "chapters", "id", "book_id", F.col("content").alias("text")), "id")
    return S.gender_by_pronouns(names, texts, "book_id").select("book_id", "name", "male", "female", "gender")


_COLOUR_SQL = "[" + ", ".join(f"'{c}'" for c in P.COLOURS) + "]"


@query(f"""
SELECT id, list_extract({_COLOUR_SQL}, CAST(list_sum(list_transform(string_split(md5(lower(name)), ''), lambda d: instr('0123456789abcdef', d) - 1)) % 15 + 1 AS INTEGER)) AS color FROM characters
""")
def t19_voice_colours(spark, sf):
    return table(spark, sf, "characters", "id", "name").select("id", T.voice_colour("name").alias("color"))


@query()
def t19_voices(spark, sf):
    return S.voices(table(spark, sf, "characters", "id", "name", "gender"), "name", "gender").select("id", "instruct", "color_hex")


@query(f"""
WITH t AS (SELECT id, list_filter(list_transform(string_split(lower(coalesce(instruct, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS ts FROM characters)
SELECT id, list_extract(list_filter(ts, lambda x: x IN {_sql_in(T.GENDERS)}), -1) AS gender, list_extract(list_filter(ts, lambda x: x IN {_sql_in(T.AGES)}), -1) AS age,
 list_extract(list_filter(ts, lambda x: x IN {_sql_in(T.PITCHES)}), -1) AS pitch, list_extract(list_filter(ts, lambda x: x LIKE '%accent'), -1) AS accent FROM t
""")
def t20_parsed_instructs(spark, sf):
    p = T.parse_instruct("instruct")
    return table(spark, sf, "characters", "id", "instruct").select("id", *[p[c].alias(c) for c in ("gender", "age", "pitch", "accent")])


@query()
def t21_stable_instructs(spark, sf):
    return table(spark, sf, "characters", "id", "instruct").select("id", T.stable_instruct("instruct").alias("instruct"))


@query(f"""
SELECT id, md5(text || '|' || coalesce(instruct, 'None') || '|None|None|' || printf('%.2f', speed) || '||nt=0|ns=16|audio-cache-v=2') AS cache_key FROM ({_SEGMENTS}) WHERE text IS NOT NULL AND speed IS NOT NULL
""")
def t23_cache_keys(spark, sf):
    s = _segments(spark, sf, "id", "text", "instruct", "speed").where("text is not null and speed is not null")
    none = F.lit(None).cast("string")
    return s.select("id", T.cache_key("text", "instruct", none, none, "speed", none).alias("cache_key"))


@query(r"""
SELECT id, CASE WHEN speed <= 0.72 THEN '<|prosody:speed_very_slow|>' WHEN speed < 0.94 THEN '<|prosody:speed_slow|>' WHEN speed >= 1.32 THEN '<|prosody:speed_very_fast|>' WHEN speed > 1.08 THEN '<|prosody:speed_fast|>' ELSE '' END
 || CASE WHEN contains(lower(coalesce(instruct, '')), 'whisper') THEN '<|style:whispering|>' ELSE '' END
 || CASE WHEN contains(lower(coalesce(instruct, '')), 'low pitch') THEN '<|prosody:pitch_low|>' WHEN contains(lower(coalesce(instruct, '')), 'high pitch') THEN '<|prosody:pitch_high|>' ELSE '' END AS tokens
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS n FROM tts_segments) WHERE n = 1)
""")
def t30_control_tokens(spark, sf):
    s = _segments(spark, sf, "id", "speed", "instruct")
    return s.select("id", F.concat(T.speed_token("speed"), T.instruct_tokens("instruct")).alias("tokens"))


@query("SELECT c.id, md5(CASE WHEN lower(coalesce(b.language, '')) IN ('hu', 'hungarian') THEN translate(c.content, 'õûÕÛ', 'őűŐŰ') ELSE c.content END) AS digest FROM chapters c JOIN books b ON b.id = c.book_id")
def t31_legacy_glyphs(spark, sf):
    b = table(spark, sf, "books", F.col("id").alias("book_id"), "language")
    return table(spark, sf, "chapters", "id", "book_id", "content").join(b, "book_id").select("id", F.md5(T.repair_glyphs("content", "language")).alias("digest"))


# the cleaner in SQL: blanks, edge marks, fields behind a bar, "speech, Name" fragments, names of nobody
_FLAT = f"string_split(trim(regexp_replace(coalesce(speaker_name, ''), '[{_B}]+', ' ', 'g'), E' \\t\\r\\n.,;:!?\"''„”'), '|')[1]"
_COMMA = f"list_transform(string_split(trim({_FLAT}), ','), lambda x: trim(x))"
_NWORDS = "len(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_NAME_SQL = f"(CASE WHEN len({_COMMA}) = 2 AND {_NWORDS.format(_COMMA + '[1]')} > 1 AND {_NWORDS.format(_COMMA + '[2]')} BETWEEN 1 AND 3 THEN {_COMMA}[2] ELSE trim({_FLAT}) END)"
_CLEAN_SPEAKER_SQL = f"(CASE WHEN lower({_NAME_SQL}) IN ('', 'narrator', 'narrátor', 'narration', 'elbeszélő', 'unknown', 'ismeretlen', 'none', 'null') THEN '' ELSE substr({_NAME_SQL}, 1, 120) END)"


@query(f"SELECT id, {_CLEAN_SPEAKER_SQL} AS speaker FROM speaker_annotations")
def t33_clean_speakers(spark, sf):
    return table(spark, sf, "speaker_annotations", "id", "speaker_name").select("id", T.clean_speaker("speaker_name").alias("speaker"))


@query(f"SELECT id, CAST(floor(len({_sql_words('content')}) / 250.0 + 0.5) AS INTEGER) AS minutes FROM chapters")
def t38_reading_minutes(spark, sf):
    return table(spark, sf, "chapters", "id", "content").select("id", T.reading_minutes(T.word_count("content")).alias("minutes"))


@query(f"""
WITH s AS (SELECT id, {_sql_words('text')} AS w, duration_sec AS d FROM ({_SEGMENTS}) WHERE duration_sec IS NOT NULL AND text IS NOT NULL), x AS (SELECT id, w, d, unnest(range(len(w))) AS i FROM s)
SELECT id, CAST(i AS INTEGER) AS i, w[i + 1] AS word, round(i * d / len(w), 6) AS t0, round((i + 1) * d / len(w), 6) AS t1 FROM x
""")
def t39_word_spans(spark, sf):
    s = _segments(spark, sf, "id", "text", "duration_sec").where("duration_sec is not null and text is not null")
    return T.word_spans(s, "text", "duration_sec", "id").withColumns({"t0": F.round("t0", 6), "t1": F.round("t1", 6)})


# ---------------------------------------------------------------- segmentation

_LINES = (
    f"SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT id, regexp_split_to_array(regexp_replace(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), '[{P.LINE_ENDS}]$', ''), '[{P.LINE_ENDS}]') AS l FROM chapters WHERE content IS NOT NULL)"
)


@query(f"SELECT id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM ({_LINES}) GROUP BY id")
def g0_lines(spark, sf):
    return G.lines(table(spark, sf, "chapters", "id", "content"), "id", "content").groupBy("id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_HEAD = f"(length({_sql_strip('line')}) BETWEEN 1 AND 150 AND regexp_matches({_sql_strip('line')}, {_q(P.SECTION)}))"


def _book_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each book (book_id, part, pos, line): titles become lines before their chapters; a part is a chapter's place."""
    c = table(spark, sf, "chapters", "book_id", "order_num", "title", "content")
    c = c.select(F.struct("book_id", F.col("order_num").cast("long").alias("part")).alias("k"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("content"))
    return G.lines(c, "k", "content").select("k.book_id", "k.part", "pos", "line")


_BOOK_LINES = (
    f"SELECT book_id, CAST(order_num AS BIGINT) AS part, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT book_id, order_num, regexp_split_to_array(regexp_replace(replace(concat_ws(chr(10), coalesce(title, ''), coalesce(content, '')), chr(13) || chr(10), chr(10)), '[{P.LINE_ENDS}]$', ''), '[{P.LINE_ENDS}]') AS l FROM chapters)"
)


@query(f"SELECT book_id, part, CAST(pos AS INTEGER) AS pos, {_sql_strip('line')} AS title FROM ({_BOOK_LINES}) WHERE {_HEAD}")
def g1_explicit_headings(spark, sf):
    return _book_lines(spark, sf).where(T.is_explicit_section("line")).select("book_id", "part", "pos", T.strip("line").alias("title"))


@query(f"""
WITH m AS (SELECT *, {_HEAD} AS h FROM ({_BOOK_LINES})), i AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY part, pos) AS island, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) AS n FROM m),
g AS (SELECT book_id, island, max(CASE WHEN h THEN line END) AS title, {_sql_strip("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY part, pos), '')")} AS content FROM i WHERE n >= 2 GROUP BY 1, 2)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY island) - 1 AS INTEGER) AS order_num, {_sql_strip('title')} AS title, CAST(length(content) AS INTEGER) AS chars FROM g WHERE length(content) > 100
""")
def g2_chapter_islands(spark, sf):
    """Books cut anew at explicit headings (books that have at least two)."""
    rows = _book_lines(spark, sf).withColumn("is_heading", T.is_explicit_section("line"))
    some = rows.groupBy("book_id").agg(F.sum(F.col("is_heading").cast("int")).alias("n")).where("n >= 2")
    made = G.chapters_of(rows.join(some.select("book_id"), "book_id", "left_semi"), "book_id", part="part")
    return made.select("book_id", "order_num", "title", F.length("content").alias("chars"))


@query()
def g3_chapters_adaptive(spark, sf):
    """As above, with headings in capitals for books without explicit ones."""
    return G.chapters_of(G.marked_lines(_book_lines(spark, sf), "book_id"), "book_id", part="part").select("book_id", "order_num", "title", "words")


@query()
def g4_paragraphs(spark, sf):
    return G.paragraph_table(spread(table(spark, sf, "chapters", "id", "content"), "id"), "id", "content")


@query(r"""
SELECT id, CAST(len(string_split(regexp_replace(content, '([.!?]["”]?)[ \n]+(["“]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS INTEGER) AS sentences FROM chapters WHERE content IS NOT NULL
""")
def g5_rough_sentences(spark, sf):
    return table(spark, sf, "chapters", "id", "content").where("content is not null").select("id", F.size(G.rough_sentences("content")).alias("sentences"))


@query()
def g6_default_units(spark, sf):
    return G.unit_table(spread(table(spark, sf, "chapters", "id", "content"), "id"), "id", "content")


@query()
def g6_single_narrator_units(spark, sf):
    return G.unit_table(spread(table(spark, sf, "chapters", "id", "content"), "id"), "id", "content", single=True)


@query()
def g7_speaker_units(spark, sf):
    return G.speaker_unit_table(spread(table(spark, sf, "chapters", "id", "content"), "id").withColumnRenamed("id", "chapter_id"), "content", "chapter_id")


@query(f"""
WITH a AS (SELECT chapter_id, unit_index, CASE WHEN unit_index % 3 = 2 THEN NULL ELSE speaker_name END AS sp, unit_index // 3 AS turn FROM ({_ANN})),
w AS (SELECT *, min(nullif({_sql_strip('sp')}, '')) OVER (PARTITION BY chapter_id, turn) AS lo, max(nullif({_sql_strip('sp')}, '')) OVER (PARTITION BY chapter_id, turn) AS hi FROM a)
SELECT chapter_id, unit_index, coalesce(sp, CASE WHEN lo = hi THEN lo END) AS effective_speaker FROM w
""")
def g8_turn_expansion(spark, sf):
    """Every third annotation of a turn of three is taken away and filled from its turn where that names one speaker."""
    a = _annotations(spark, sf, "speaker_name")
    a = a.select("chapter_id", "unit_index", F.floor(F.col("unit_index") / 3).cast("int").alias("turn_index"), F.when(F.col("unit_index") % 3 != 2, F.col("speaker_name")).alias("speaker_name"))
    return S.expand_turns(a).select("chapter_id", "unit_index", "effective_speaker")


@query()
def g9_dialogue_map(spark, sf):
    return S.dialogue_pairs(spread(table(spark, sf, "chapters", "id", "content"), "id"), "id", "content")


@query()
def g10_found_speakers(spark, sf):
    """Speakers of quotations by containment in the chapter's dialogue map."""
    chapters = spread(table(spark, sf, "chapters", F.col("id").alias("chapter_id"), "content"), "chapter_id")
    s = table(spark, sf, "speaker_annotations", "chapter_id", F.col("id").alias("sentence_no"), F.col("unit_text").alias("sentence"))
    return S.find_speakers(s, S.dialogue_pairs(chapters, "chapter_id", "content"), "chapter_id").select("chapter_id", "sentence_no", "speaker")


_SAID_SQL = "said|replied|asked|answered|whispered|shouted|cried|muttered|exclaimed|called|added|continued|laughed|sighed|groaned|snapped|retorted|insisted|demanded|pleaded|began|noted|observed|remarked"


@query(f"""
WITH c AS (SELECT book_id, order_num, id, regexp_extract_all(content, '\\b([A-Z][a-z]+(?:\\s[A-Z][a-z]+)?)\\s+(?:{_SAID_SQL})\\b', 1) AS one,
 regexp_extract_all(content, '"[^"]{{3,}}"\\s*[,.]?\\s*([A-Z][a-z]+(?:\\s[A-Z][a-z]+)?)\\s+(?:said|replied|asked|whispered|shouted|cried|muttered|exclaimed|called)\\b', 1) AS two FROM chapters),
m AS (SELECT book_id, 0 AS kind, order_num, id, unnest(range(len(one))) AS place, unnest(one) AS name FROM c UNION ALL SELECT book_id, 1, order_num, id, unnest(range(len(two))), unnest(two) FROM c),
n AS (SELECT book_id, name, count(*) AS frequency, min((kind, order_num, id, place)) AS p FROM m GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY frequency DESC, p, name) AS r FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY frequency DESC, p, name) AS r2 FROM t WHERE r <= 40 AND length(name) >= 2
 AND name NOT IN ('The', 'A', 'An', 'He', 'She', 'It', 'They', 'We', 'You', 'I', 'And', 'But', 'Or', 'So', 'As', 'In', 'On', 'At', 'By', 'For', 'His', 'Her', 'Their', 'Its', 'Our', 'Your'))
SELECT book_id, name, frequency FROM k WHERE r2 <= 20
""")
def g12_mentions(spark, sf):
    """The names most often said to speak in each book; chapters are read by themselves and their counts added up."""
    return S.mentions(table(spark, sf, "chapters", "book_id", "order_num", "id", "content"), "book_id", "content", "order_num", "id")


# ---------------------------------------------------------------- model replies, corrections


@query(f"""
WITH a AS (SELECT chapter_id, unit_index AS unit_id, id, {_CLEAN_SPEAKER_SQL} AS speaker FROM speaker_annotations WHERE unit_index IS NOT NULL)
SELECT chapter_id, unit_id, speaker FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, unit_id ORDER BY id) AS n FROM a WHERE speaker <> '') WHERE n = 1
""")
def l8_assignments(spark, sf):
    """Replies in the model's JSON form, of all annotations as they are, read back: the first valid assignment of each unit holds.
    """
    a = table(spark, sf, "speaker_annotations", "chapter_id", "unit_index", "id", "speaker_name")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", "unit_index", "speaker_name"))), lambda x: F.concat(text(x["unit_index"]), F.lit("|"), text(x["speaker_name"])))
    made = a.groupBy("chapter_id").agg(F.to_json(F.struct(rows.alias("dialogues"))).alias("reply"))
    return S.replies(made, "chapter_id", "reply").select("chapter_id", "unit_id", "speaker")


@query()
def l9_consolidated_names(spark, sf):
    return S.consolidate(table(spark, sf, "characters", "book_id", "name", "frequency").groupBy("book_id", "name").agg(F.max("frequency").alias("frequency")), "book_id")


@query("""
SELECT book_id, name, frequency FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY frequency DESC, name) AS n FROM (SELECT book_id, speaker_name AS name, count(*) AS frequency FROM speaker_annotations WHERE speaker_name <> '' GROUP BY 1, 2)) WHERE n <= 5
""")
def l10_top_speakers(spark, sf):
    """The five busiest speakers of each book."""
    n = table(spark, sf, "speaker_annotations", "book_id", F.col("speaker_name").alias("name")).where("name <> ''").groupBy("book_id", "name").agg(F.count("*").alias("frequency"))
    return n.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("frequency"), "name"))).where("n <= 5").drop("n")


# ---------------------------------------------------------------- sequences, batches, export


@query(f"""
WITH a AS ({_ANN}), f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker_name IS DISTINCT FROM lag(speaker_name) OVER w THEN 1 ELSE 0 END AS f FROM a WINDOW w AS (PARTITION BY chapter_id ORDER BY unit_index)),
r AS (SELECT *, sum(f) OVER (PARTITION BY chapter_id ORDER BY unit_index) - 1 AS run FROM f)
SELECT chapter_id, CAST(run AS BIGINT) AS run, min(speaker_name) AS speaker, min(unit_index) AS first, max(unit_index) AS last, count(*) AS units FROM r GROUP BY chapter_id, run
""")
def w4_speaker_runs(spark, sf):
    return C.speaker_runs(_annotations(spark, sf, "speaker_name"), ["chapter_id"], "unit_index", "speaker_name")


_PAUSE_SQL = (
    f"CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[{_B}]+$', ''), '[\"''”’»]+$', ''), '[{_B}]+$', ''), '(\\.\\.\\.|…)$') THEN 1.5 "
    "WHEN coalesce(ends_paragraph, 0) <> 0 THEN 0.85 WHEN coalesce(is_dialogue, 0) <> 0 AND coalesce(lead(is_dialogue) OVER w, 0) <> 0 THEN 0.55 ELSE 0.35 END"
)
_TIMED = f"""
WITH s AS ({_SEGMENTS}), p AS (SELECT *, CAST({_PAUSE_SQL} AS DOUBLE) AS pause FROM s WINDOW w AS (PARTITION BY chapter_id ORDER BY segment_index)),
t AS (SELECT *, coalesce(sum(coalesce(duration_sec, 0.0) + pause) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS t_start FROM p)
"""


@query(_TIMED + "SELECT id, chapter_id, segment_index, pause, round(t_start, 4) AS t_start, round(t_start + coalesce(duration_sec, 0.0), 4) AS t_end FROM t")
def w2_timeline(spark, sf):
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text", "ends_paragraph", "is_dialogue", "duration_sec")
    out = C.timeline(s, ["chapter_id"], "segment_index")
    return out.select("id", "chapter_id", "segment_index", "pause", F.round("t_start", 4).alias("t_start"), F.round("t_end", 4).alias("t_end"))


@query()
def k3_srt(spark, sf):
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text", "ends_paragraph", "is_dialogue", "duration_sec")
    return C.srt(C.timeline(s, ["chapter_id"], "segment_index"), ["chapter_id"], "segment_index")


@query()
def k4_ass(spark, sf):
    s = _segments(spark, sf, "id", "book_id", "chapter_id", "segment_index", "text", "character_name", "ends_paragraph", "is_dialogue", "duration_sec")
    return C.ass(C.timeline(s, ["book_id", "chapter_id"], "segment_index"), table(spark, sf, "characters", "book_id", "name", "color_hex"), ["book_id", "chapter_id"], "segment_index", "Export")


@query("""
WITH m AS (SELECT book_id, greatest(2, length(CAST(max(n) AS VARCHAR))) AS width FROM (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY order_num, id) AS n FROM chapters) GROUP BY book_id),
c AS (SELECT id, book_id, title, row_number() OVER (PARTITION BY book_id ORDER BY order_num, id) AS n FROM chapters)
SELECT c.id, lpad(CAST(c.n AS VARCHAR), CAST(m.width AS INTEGER), '0') AS number FROM c JOIN m ON m.book_id = c.book_id
""")
def k6_file_numbers(spark, sf):
    w = Window.partitionBy("book_id").orderBy("order_num", "id")
    c = table(spark, sf, "chapters", "id", "book_id", "order_num").withColumn("n", F.row_number().over(w))
    width = F.greatest(F.lit(2), F.length(F.max("n").over(Window.partitionBy("book_id")).cast("string")))
    return c.withColumn("w", width).select("id", F.lpad(F.col("n").cast("string"), F.col("w"), F.lit("0")).alias("number"))


@query()
def k10_file_names(spark, sf):
    b = table(spark, sf, "books", "id", "author", "title")
    return b.select("id", T.safe_name("title").alias("file_name"), T.export_dir("author", "title").alias("folder"))


@query(f"""
WITH s AS ({_SEGMENTS}) SELECT id, CASE WHEN cache_key IS NOT NULL AND cache_key IN (SELECT cache_key FROM s WHERE audio_path IS NOT NULL AND cache_key IS NOT NULL) THEN 'hit' ELSE 'miss' END AS part FROM s
""")
def b4_cache_partition(spark, sf):
    s = _segments(spark, sf, "id", "cache_key", "audio_path")
    hit, miss = C.cache_split(s, s.where("audio_path is not null"))
    return hit.select("id", F.lit("hit").alias("part")).unionByName(miss.select("id", F.lit("miss").alias("part")))


@query(f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT id, book_id, voice, size, row_number() OVER (PARTITION BY book_id, voice ORDER BY size, id) AS k FROM (SELECT id, book_id, coalesce(instruct, '') AS voice, length(coalesce(text, '')) AS size FROM ({_SEGMENTS}))),
u AS (SELECT *, 1 AS n, size AS total, 0 AS pack_no FROM s WHERE k = 1 UNION ALL
 SELECT s.id, s.book_id, s.voice, s.size, s.k, CASE WHEN u.n >= 8 OR u.total + s.size > 12000 THEN 1 ELSE u.n + 1 END, CASE WHEN u.n >= 8 OR u.total + s.size > 12000 THEN s.size ELSE u.total + s.size END,
  CASE WHEN u.n >= 8 OR u.total + s.size > 12000 THEN u.pack_no + 1 ELSE u.pack_no END FROM u JOIN s ON s.book_id = u.book_id AND s.voice = u.voice AND s.k = u.k + 1)
SELECT id, book_id, voice, CAST(size AS INTEGER) AS size, pack_no FROM u
""")
def b7_packs(spark, sf):
    """Segments of one voice, sorted by length, in packs of at most 8 items and 12,000 characters."""
    s = _segments(spark, sf, "id", "book_id", "instruct", "text").select("id", "book_id", F.coalesce("instruct", F.lit("")).alias("voice"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return C.packs(s, ["book_id", "voice"], ["size", "id"], "size", 8, 12_000)


@query(f"""
WITH s AS (SELECT id, chapter_id, segment_index, CAST(power(greatest(32, length(coalesce(text, ''))), 2) AS BIGINT) AS cost FROM ({_SEGMENTS})),
r AS (SELECT *, sum(cost) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, row_number() OVER (PARTITION BY chapter_id ORDER BY segment_index) - 1 AS k, sum(cost) OVER (PARTITION BY chapter_id) AS total FROM s),
c AS (SELECT chapter_id, k AS cut FROM (SELECT chapter_id, k, row_number() OVER (PARTITION BY chapter_id ORDER BY abs(total / 2.0 - run), k) AS n FROM r WHERE k > 0) WHERE n = 1)
SELECT r.id, CASE WHEN r.k >= c.cut THEN 1 ELSE 0 END AS lane FROM r LEFT JOIN c ON c.chapter_id = r.chapter_id
""")
def b10_lanes(spark, sf):
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text").withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    return C.lanes(s, "chapter_id", "segment_index", "size").select("id", "lane")


@query("""
WITH n AS (SELECT book_id, CAST(count(*) AS INTEGER) AS n FROM chapters GROUP BY book_id)
SELECT book_id, CAST(unnest(CASE WHEN n >= 5 THEN [1, 3, 4, 5] ELSE range(1, n + 1) END) AS INTEGER) AS chapter_number FROM n
""")
def b16_selection(spark, sf):
    """'5, 1, 3-4, 3' of every book with five chapters, all chapters of the others."""
    n = table(spark, sf, "chapters", "book_id").groupBy("book_id").agg(F.count("*").cast("int").alias("n"))
    wanted = F.when(F.col("n") >= 5, "5, 1, 3-4, 3").otherwise("all")
    return n.select("book_id", F.explode(T.number_range(wanted, "n")).alias("chapter_number"))


@query("SELECT e.event_type, count(*) AS n, count(DISTINCT e.user_id) AS users, round(sum(e.value), 4) AS total FROM events e GROUP BY e.event_type")
def x1_event_totals(spark, sf):
    return table(spark, sf, "events", "event_type", "user_id", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


# ---------------------------------------------------------------- streams, run to the end of what is there


@query("""
SELECT user_id, event_id % 50 AS chapter_id, CAST(floor(value) AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def b14_stream_progress(spark, sf):
    """The latest event of each user, kept by a stream of upserts."""
    from ..session import shared_folder
    from ..streaming import jobs

    root = shared_folder(spark, "progress")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parq*")
    jobs.progress(stream, f"{root}/table", f"{root}/state").awaitTermination()
    return jobs.last_version(spark, f"{root}/table").drop("ts")


@query("""
WITH k AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id) SELECT e.event_id, k.first AS result FROM events e JOIN k ON k.user_id = e.user_id
""")
def b2_stream_shared_requests(spark, sf):
    """Requests for one key share the result of the first."""
    from ..session import shared_folder
    from ..streaming import jobs

    root = shared_folder(spark, "requests")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parq*")
    render = lambda first: first.select("user_id", F.col("event_id").alias("result"), F.lit(None).cast("string").alias("error"))
    jobs.requests(stream, "user_id", render, f"{root}/table", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/table").select("event_id", "result")


@query()
def b14_debounced_positions(spark, sf):
    from ..streaming import jobs

    return jobs.debounced(table(spark, sf, "events", "event_id", "ts", "user_id", "value"), "1 hour")
