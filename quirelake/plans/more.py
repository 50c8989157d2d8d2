"""More queries over whole tables: sources, small arithmetic, batches, analysis, corrections, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import analysis as A
from ..operators import enrichment as E
from ..operators import schedule as C
from ..operators import segmentation as G
from ..operators import speakers as S
from ..operators import store as R
from ..session import spread, table
from ..sources import plain as L
from .queries import _ANN, _B, _FOLD, _LINES, _PAUSE_SQL, _SEGMENTS, _annotations, _segments, _sql_strip, query

# ---------------------------------------------------------------- sources


@query(f"""
WITH l AS ({_LINES}), t AS (SELECT id, min_by({_sql_strip('line')}, pos) AS title FROM l WHERE pos < 20 AND length({_sql_strip('line')}) BETWEEN 1 AND 119 GROUP BY id)
SELECT c.id, coalesce(t.title, 'Unknown Title') AS title, coalesce(nullif(regexp_extract(substr(c.content, 1, 500), '\\bby[ \\t]+([A-Z][a-z]+(?:[ \\t]+[A-Z][a-z]+)+)', 1), ''), 'Unknown') AS author
FROM chapters c LEFT JOIN t ON t.id = c.id WHERE c.content IS NOT NULL
""")
def s2_guessed_titles(spark, sf):
    """Title and author as a plain text tells them."""
    c = table(spark, sf, "chapters", "id", "content").where("content is not null")
    return G._exploded(spread(c, "id"), ["id"], "content", lambda t: [G.plain_text_chapters(t)[:2]], "title string, author string", ["title", "author"])


@query()
def s8_plain_chapters(spark, sf):
    """Every text cut as a plain-text book: headings, skipped matter, fallback."""
    c = table(spark, sf, "chapters", "id", F.concat_ws("\n", F.coalesce("title", F.lit("")), "content").alias("content"))
    return G.plain_chapter_table(spread(c, "id"), "id", "content")


@query(f"SELECT id, count(*) AS lines, md5(string_agg(s, chr(10) ORDER BY pos)) AS digest FROM (SELECT id, pos, trim(regexp_replace(line, '[{_B}]+', ' ', 'g')) AS s FROM ({_LINES})) WHERE s <> '' GROUP BY id")
def s17_html_lines(spark, sf):
    """The visible lines of pages made of the chapters."""
    body = F.regexp_replace(F.replace(F.replace(F.replace(F.col("content"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\n", "</p><script>x</script><p>")
    c = spread(table(spark, sf, "chapters", "id", "content"), "id").select("id", F.concat(F.lit("<html><style>y</style><p>"), body, F.lit("</p></html>")).alias("html")).where("html is not null")
    rows = L.html_line_table(c, "id", "html")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("id").agg(F.count("*").alias("lines"), F.md5(body).alias("digest"))


_BLOCKS = f"SELECT id, pos, {_sql_strip('line')} AS text, CASE WHEN length(line) % 5 = 0 AND length(line) < 60 THEN CAST(18 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS size FROM ({_LINES}) WHERE {_sql_strip('line')} <> ''"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a page layout made of the chapters: some short ones stand in larger type."""
    rows = G.lines(table(spark, sf, "chapters", "id", "content"), "id", "content")
    size = F.when((F.length("line") % 5 == 0) & (F.length("line") < 60), 18.0).otherwise(12.0)
    return rows.select("id", "pos", T.strip("line").alias("text"), size.alias("size")).where("text <> ''")


@query(f"SELECT id, s AS body FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS k FROM (SELECT id, round(size, 2) AS s, count(*) AS n, min(pos) AS p FROM ({_BLOCKS}) GROUP BY 1, 2)) WHERE k = 1")
def s12_body_sizes(spark, sf):
    """The commonest type size of each text, the first seen of equals."""
    return L.body_size(_blocks(spark, sf), "id")


@query(f"""
WITH b AS ({_BLOCKS}), z AS (SELECT id, s AS body FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS k FROM (SELECT id, round(size, 2) AS s, count(*) AS n, min(pos) AS p FROM b GROUP BY 1, 2)) WHERE k = 1),
m AS (SELECT b.*, length(text) <= 150 AND regexp_matches(text, '{P.SECTION.replace("(?iuU)", "(?i)").replace("'", "''")}') AS e,
 length(text) < 120 AND size > body + 0.5 AND regexp_matches(text, '(?i)\\b(chapter|part|prologue|epilogue|foreword|preface|introduction|afterword|appendix|interlude|fejezet|rész)\\b') AS g FROM b JOIN z ON z.id = b.id),
h AS (SELECT *, e OR (g AND sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY id) < 2) AS h FROM m),
i AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS island FROM h),
g AS (SELECT id, island, max(CASE WHEN h THEN text END) AS title, trim(coalesce(string_agg(CASE WHEN NOT h THEN text END, ' ' ORDER BY pos), '')) AS content FROM i GROUP BY 1, 2)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY island) - 1 AS INTEGER) AS order_num, coalesce(title, 'Untitled') AS title, md5(content) AS digest FROM g WHERE length(content) > 100
""")
def s14_layout_chapters(spark, sf):
    """Page layouts cut into chapters by markers or large section words."""
    return L.layout_chapters(_blocks(spark, sf), "id", "Untitled").select("id", "order_num", "title", F.md5("content").alias("digest"))


@query("SELECT id, n AS page FROM (SELECT id, id % 500 AS n, id % 7 AS k FROM chapters) WHERE NOT (k IN (0, 1, 2) AND n > 0)")
def s11_page_numbers(spark, sf):
    """Lines of figures are dropped where they stand in the middle of the page (within 8 % of its width)."""
    n, k = F.col("id") % 500, F.col("id") % 7
    left = F.when(n == 0, 20.0).otherwise(280.0 + k * 24.0)
    rows = table(spark, sf, "chapters", "id").select("id", n.cast("string").alias("text"), F.array(left, F.lit(0.0), left + 20, F.lit(9.0)).alias("bbox"), F.lit(600.0).alias("page_width"))
    return L.without_page_numbers(rows).select("id", F.col("text").cast("long").alias("page"))


# ---------------------------------------------------------------- scalar functions


@query()
def t1_composed(spark, sf):
    """The normaliser with composition."""
    return spread(table(spark, sf, "chapters", "id", "content"), "id").select("id", F.md5(T.normalise("content")).alias("digest"))


_TOKENS = f"list_filter(list_transform(string_split(coalesce(instruct, ''), ','), lambda t: lower({_sql_strip('t')})), lambda t: t <> '')"


@query(f"""
WITH t AS (SELECT id, {_TOKENS} AS ts FROM characters)
SELECT id, coalesce(list_filter(ts, lambda x: x IN ('male', 'female'))[1], 'female') || ', ' || coalesce(list_filter(['child', 'teenager', 'young adult', 'middle-aged', 'elderly'], lambda x: list_contains(ts, x))[1], 'young adult')
 || ', ' || coalesce(list_filter(['very low pitch', 'low pitch', 'moderate pitch', 'high pitch', 'very high pitch'], lambda x: list_contains(ts, x))[1], 'moderate pitch')
 || ', ' || coalesce(list_filter(['american accent', 'british accent', 'australian accent', 'canadian accent', 'indian accent', 'chinese accent', 'korean accent', 'japanese accent'], lambda x: list_contains(ts, x))[1], 'american accent') AS voice FROM t
""")
def t22_studio_voices(spark, sf):
    return table(spark, sf, "characters", "id", "instruct").select("id", T.studio_voice("instruct").alias("voice"))


@query(f"""
SELECT id, md5('higgs-v6|' || text || '|' || coalesce(instruct, 'None') || '|None|None|' || printf('%.3f', speed) || '||nt=0|(''raw'', ''none'', ''none'', ''none'')|{{''temperature'': 0.8, ''top_p'': 0.95, ''top_k'': 50, ''max_new_tokens'': 1024, ''seed'': -1}}') AS cache_key
FROM ({_SEGMENTS}) WHERE text IS NOT NULL AND speed IS NOT NULL
""")
def t24_second_cache_keys(spark, sf):
    s = _segments(spark, sf, "id", "text", "instruct", "speed").where("text is not null and speed is not null")
    none = F.lit(None).cast("string")
    return s.select("id", T.second_cache_key("text", "instruct", none, "speed", none, none).alias("cache_key"))


@query("""
SELECT id, CASE WHEN ref_audio_path IS NOT NULL THEN md5(CASE WHEN id % 2 = 0 THEN ref_audio_path || '|' || CAST(id * 1000 AS VARCHAR) || '|' || CAST(length(ref_audio_path) AS VARCHAR) || '|' || coalesce(ref_text, '') ELSE ref_audio_path || '|' || coalesce(ref_text, '') END) END AS reference_key FROM characters
""")
def t25_reference_keys(spark, sf):
    """Keys of reference recordings; of those with even ids the file is there."""
    k, there = table(spark, sf, "characters", "id", "ref_audio_path", "ref_text"), F.col("id") % 2 == 0
    return k.select("id", T.reference_key("ref_audio_path", F.when(there, F.col("id") * 1000), F.when(there, F.length("ref_audio_path")), "ref_text").alias("reference_key"))


@query()
def t27_numbers_in_words(spark, sf):
    """Whole numbers of the segments of English books in words; other languages keep figures."""
    b = table(spark, sf, "books", F.col("id").alias("book_id"), "language")
    s = _segments(spark, sf, "id", "book_id", "text").join(b, "book_id", "left")
    return s.select("id", T.numbers_spelled("text", T.normaliser_language("language", "text")).alias("text"))


@query(f"""
SELECT id, CASE WHEN c IN ('en', 'english') THEN 'en' WHEN c IN ('zh', 'zh-cn', 'zh-tw', 'chinese', 'mandarin') THEN 'zh' WHEN c IN ('ja', 'japanese') THEN 'ja' WHEN c NOT IN ('', 'none', 'auto') THEN c
 WHEN regexp_matches(title, '[一-鿿]') THEN 'zh' WHEN regexp_matches(title, '[぀-ヿ]') THEN 'ja' ELSE 'en' END AS lang FROM (SELECT id, coalesce(title, '') AS title, lower({_sql_strip("coalesce(language, '')")}) AS c FROM books)
""")
def t28_normaliser_languages(spark, sf):
    return table(spark, sf, "books", "id", "language", F.coalesce("title", F.lit("")).alias("title")).select("id", T.normaliser_language("language", "title").alias("lang"))


_TRANSLATED = "coalesce(enriched_text, '')"
for _tag, _token in {
    "laughter": "<|sfx:laughter|>Haha", "sigh": "<|sfx:sigh|>Uh", "dissatisfaction-hnn": "<|emotion:bitterness|>", "confirmation-en": "", "question-ei": "<|emotion:contemplation|>", "question-oh": "<|emotion:surprise|>",
    "question-ah": "<|emotion:confusion|>", "surprise-ah": "<|emotion:surprise|>", "surprise-oh": "<|emotion:surprise|>", "surprise-wa": "<|emotion:awe|>", "surprise-yo": "<|emotion:elation|>",
}.items():
    _TRANSLATED = f"replace({_TRANSLATED}, '[{_tag}]', '{_token}')"


@query(rf"SELECT id, regexp_replace({_TRANSLATED}, '\[[^\[\]]*\]', '', 'g') AS text FROM ({_SEGMENTS})")
def t29_translated_tags(spark, sf):
    return _segments(spark, sf, "id", "enriched_text").select("id", T.control_tokens(F.coalesce("enriched_text", F.lit(""))).alias("text"))


@query("""SELECT id, CASE WHEN id % 5 <> 0 THEN '{"id":' || CAST(id AS VARCHAR) || ',"ok":true}' END AS reply FROM books""")
def t32_framed_replies(spark, sf):
    """Replies found in output mixed with progress; every fifth line has none."""
    line = F.concat(F.lit("12% \x1b[0m "), F.when(F.col("id") % 5 != 0, F.lit(T.REPLY_MARK)).otherwise("no mark "), F.lit(' {"id": '), F.col("id").cast("string"), F.lit(', "ok": true} {"late": 1} }'))
    return table(spark, sf, "books", "id").select("id", T.framed_reply(line).alias("reply"))


@query(f"""
WITH j AS (SELECT chapter_id, count(*) AS total, count(audio_path) AS done, CAST(round(coalesce(sum(duration_sec) FILTER (WHERE audio_path IS NOT NULL), 0) * 60) AS BIGINT) AS e FROM ({_SEGMENTS}) GROUP BY chapter_id),
s AS (SELECT chapter_id, CASE WHEN done < total AND e >= 3 AND done > 0 THEN CAST(round_even((total - done) / (done / e), 0) AS BIGINT) END AS s FROM j)
SELECT chapter_id, CASE WHEN s IS NULL THEN '' WHEN s < 60 THEN printf('%ds', s) WHEN s // 60 < 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm', s // 3600, s // 60 % 60) END AS eta FROM s
""")
def t37_eta_texts(spark, sf):
    """How long the rest of each chapter would take at the pace so far (a minute of work a second of audio)."""
    s = _segments(spark, sf, "id", "chapter_id", "audio_path", "duration_sec")
    j = s.groupBy("chapter_id").agg(F.count("*").alias("total"), F.count("audio_path").alias("done"), (F.coalesce(F.sum(F.when(F.col("audio_path").isNotNull(), F.col("duration_sec"))), F.lit(0.0)) * 60).alias("e")).withColumn("e", F.round("e").cast("long"))
    return j.select("chapter_id", T.eta_text(T.eta_seconds("done", "total", "e")).alias("eta"))


_COUNTS = f"SELECT chapter_id, count(*) AS n FROM ({_SEGMENTS}) GROUP BY chapter_id"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf, "id", "chapter_id").groupBy("chapter_id").agg(F.count("*").alias("n"))


@query(f"SELECT b.id, CAST(greatest(0, least(b.segment_index, coalesce(n.n, 1) - 1)) AS BIGINT) AS at, round(greatest(0, least(b.segment_index, coalesce(n.n, 1) - 1)) / n.n * 100, 6) AS percent FROM bookmarks b LEFT JOIN ({_COUNTS}) n ON n.chapter_id = b.chapter_id")
def t40_bookmark_progress(spark, sf):
    """Bookmarks at a segment of their chapter, and how far through it."""
    b = table(spark, sf, "bookmarks", "id", "chapter_id", "segment_index").join(_counts(spark, sf), "chapter_id", "left")
    at = T.clamped_index(F.concat(F.lit(" "), F.col("segment_index").cast("string"), F.lit(" px")), "n")
    return b.select("id", at.alias("at"), F.round(T.progress_percent(at, "n"), 6).alias("percent"))


@query("SELECT vec_id, CASE WHEN len(x) < 2 THEN 0.0 ELSE round(list_sum(list_transform(range(1, len(x)), lambda i: abs((CASE WHEN x[i] < 0 THEN 1 ELSE 0 END) - (CASE WHEN x[i + 1] < 0 THEN 1 ELSE 0 END)))) / (len(x) - 1), 9) END AS zcr FROM (SELECT vec_id, embedding AS x FROM embeddings)")
def t42_zero_crossings(spark, sf):
    """Sign changes of series of samples."""
    return table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.round(T.zero_crossings("embedding"), 9).alias("zcr"))


@query("SELECT vec_id, CAST(CASE WHEN len(x) BETWEEN 1 AND 2 * (30 + vec_id % 60) - 1 THEN ceil(4 * (30 + vec_id % 60) / len(x)) * len(x) ELSE len(x) END AS INTEGER) AS samples FROM (SELECT vec_id, embedding AS x FROM embeddings)")
def t43_expanded_references(spark, sf):
    """Recordings shorter than two seconds repeated to four, at sample rates of 30 and more."""
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    return rows.select("vec_id", F.coalesce(*[F.when(F.col("vec_id") % 60 == k, F.size(T.expanded_reference("embedding", 30 + k))) for k in range(60)]).alias("samples"))


@query()
def t44_split_audio(spark, sf):
    """A chapter's samples divided over its segments in proportion to their characters (packs of eight)."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text").withColumn("pack", F.floor(F.col("segment_index") / 8))
    g = s.groupBy("chapter_id", "pack").agg(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"]).alias("texts"))
    return g.select("chapter_id", "pack", F.posexplode(T.split_lengths(F.lit(24_000), "texts")).alias("place", "samples"))


@query("SELECT id, CASE WHEN c IN ('hu', 'en') THEN c ELSE 'en' END AS lang, greatest(1, least(coalesce(total_chapters, 60), 200)) * CAST(1 AS DOUBLE) AS bounded, CAST(CASE WHEN t <= 12 THEN 8 WHEN t <= 20 THEN 16 WHEN t <= 28 THEN 24 ELSE 32 END AS INTEGER) AS step FROM (SELECT id, total_chapters, coalesce(total_chapters, 16) AS t, lower(trim(coalesce(language, 'en'))) AS c FROM books)")
def t45_bounded_settings(spark, sf):
    """Values held to a list, to bounds and to steps."""
    b = table(spark, sf, "books", "id", "language", "total_chapters")
    return b.select("id", T.one_of("language", ("hu", "en"), "en").alias("lang"), T.clamped("total_chapters", 1, 200, 60).alias("bounded"), T.nearest("total_chapters", (8, 16, 24, 32), 16).alias("step"))


@query("""
WITH m AS (SELECT s_nationkey AS k, ['gpt-', 'o1', 'o3-', 'llama-', 'ChatGPT-', 'tts-', 'chat-'][s_suppkey % 7 + 1] || CAST(s_suppkey % 4 AS VARCHAR) || ['', '-audio', '', '-image', '-mini'][s_suppkey % 5 + 1] AS name FROM supplier)
SELECT k, list_sort(list_distinct(list(name) FILTER (WHERE regexp_matches(lower(name), '^(gpt-|o1|o3|o4|chatgpt-|chat-)') AND NOT regexp_matches(lower(name), 'audio|realtime|transcribe|tts|image|search-preview')))) AS models FROM m GROUP BY k
""")
def t46_text_models(spark, sf):
    """The text models of lists of model names."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    k = F.col("s_suppkey")
    name = F.concat(pick(("gpt-", "o1", "o3-", "llama-", "ChatGPT-", "tts-", "chat-"), k % 7), (k % 4).cast("string"), pick(("", "-audio", "", "-image", "-mini"), k % 5))
    models = T.text_models(F.collect_list("name"))
    return table(spark, sf, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("k"), name.alias("name")).groupBy("k").agg(F.nullif(models, F.array().cast("array<string>")).alias("models"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'http://h/v1/models' WHEN 1 THEN 'http://h/v1/models' WHEN 2 THEN 'http://h/v1/chat/completions/models' END AS url FROM supplier")
def t47_endpoints(spark, sf):
    base = F.element_at(F.array(*map(F.lit, (" http://h/v1/ ", "http://h/v1/models", "http://h/v1/chat/completions//", "  "))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf, "supplier", "s_suppkey").select("s_suppkey", T.endpoint(base, "models").alias("url"))


# ---------------------------------------------------------------- sequences, batches, export


@query(f"""
WITH a AS ({_ANN}), s AS ({_SEGMENTS}), r AS (SELECT s.id, s.chapter_id, s.segment_index, s.unit_index, coalesce(s.speaker_candidate, 0) AS cand, nullif(s.character_name, '') AS who, a.source, s.segment_index % 3 <> 0 AS cont,
 nullif(lag(s.character_name) OVER (PARTITION BY s.chapter_id ORDER BY s.segment_index), '') AS prev FROM s LEFT JOIN a ON a.chapter_id = s.chapter_id AND a.unit_index = s.unit_index)
SELECT id, unit_index IS NOT NULL AND (cand <> 0 OR who IS NOT NULL OR (who IS NULL AND (coalesce(source, '') = 'manual' OR prev IS NOT NULL))) AND NOT (cont AND who IS NOT NULL AND coalesce(prev = who, false)) AS show_label FROM r
""")
def w5_labels(spark, sf):
    """Where a speaker's label stands before a segment."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "unit_index", "speaker_candidate", "character_name")
    a = _annotations(spark, sf, "source").select("chapter_id", "unit_index", F.col("source").alias("speaker_source"))
    s = s.join(a, ["chapter_id", "unit_index"], "left").withColumn("speaker_continuation", F.col("segment_index") % 3 != 0)
    return S.labelled(s, "chapter_id", "segment_index").select("id", "show_label")


@query(f"SELECT chapter_id, CAST(arg_min(segment_index, (abs(segment_index * 40 + length(coalesce(text, '')) / 2.0 - 350), segment_index)) AS INTEGER) AS segment_index FROM ({_SEGMENTS}) GROUP BY chapter_id")
def w9_nearest_segments(spark, sf):
    """The segment whose middle is nearest to a line of the view."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text")
    middle = F.col("segment_index") * 40 + F.length(F.coalesce("text", F.lit(""))) / 2.0
    return S.nearest_to(s, "chapter_id", "segment_index", middle, F.lit(350.0))


_STEPS = f"SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY segment_index, id) AS k, segment_index, coalesce(text, '') AS t, instruct, round(coalesce(speed, 1.0), 3) AS sp FROM ({_SEGMENTS})"


@query(f"""
WITH RECURSIVE s AS MATERIALIZED ({_STEPS}), u AS (
 SELECT chapter_id, k, segment_index, t, instruct, sp, length(t) AS size, 0 AS unit_no FROM s WHERE k = 1
 UNION ALL SELECT s.chapter_id, s.k, s.segment_index, s.t, s.instruct, s.sp, CASE WHEN s.instruct IS NOT DISTINCT FROM u.instruct AND s.sp = u.sp AND u.size + 1 + length(s.t) <= 400 THEN u.size + 1 + length(s.t) ELSE length(s.t) END,
  CASE WHEN s.instruct IS NOT DISTINCT FROM u.instruct AND s.sp = u.sp AND u.size + 1 + length(s.t) <= 400 THEN u.unit_no ELSE u.unit_no + 1 END FROM u JOIN s ON s.chapter_id = u.chapter_id AND s.k = u.k + 1)
SELECT chapter_id, unit_no, md5(trim(string_agg(t, ' ' ORDER BY k))) AS digest, count(*) AS members, min(segment_index) AS first FROM u GROUP BY 1, 2
""")
def b5_coalesced(spark, sf):
    """Neighbours of one voice and speed joined up to 400 characters."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text", "instruct", "speed").withColumn("speed", F.round(F.coalesce("speed", F.lit(1.0)), 3))
    return C.coalesced(s, ["chapter_id"], ["segment_index", "id"], ["instruct", "speed"], "text", 400).select("chapter_id", "unit_no", F.md5("text").alias("digest"), "members", "first")


@query("SELECT p_partkey, CAST(least(CASE WHEN p_size % 2 = 1 THEN least(greatest(1, least(p_size, 48)), 8) ELSE greatest(1, least(p_size, 48)) END, CASE WHEN p_size % 3 = 0 THEN greatest(1, p_size // 2 // 2) ELSE 999 END) AS INTEGER) AS items, CAST(greatest(500, least(greatest(12000, greatest(1, least(p_size, 48)) * 400), 40000)) AS INTEGER) AS chars FROM part")
def b8_batch_caps(spark, sf):
    """Bounds of batches: by wish, with a reference recording, after a failure."""
    p = table(spark, sf, "part", "p_partkey", "p_size")
    failed = F.when(F.col("p_size") % 3 == 0, F.floor(F.col("p_size") / 2).cast("int"))
    plain = C.batch_items("p_size", F.lit(False))
    return p.select("p_partkey", C.batch_items("p_size", F.col("p_size") % 2 == 1, failed).cast("int").alias("items"), C.batch_chars(F.lit(12_000), plain).cast("int").alias("chars"))


@query("""
SELECT p_partkey, CAST(CASE WHEN f < 2.0 THEN least(s, 4) WHEN f < 3.5 THEN least(s, 8) WHEN f < 5.0 THEN least(s, 12) ELSE s END AS INTEGER) AS items FROM (
 SELECT p_partkey, (p_partkey % 13) / 2.0 AS f, CASE WHEN p_size >= 20 THEN CASE WHEN c THEN 8 ELSE 16 END WHEN p_size >= 14 THEN CASE WHEN c THEN 6 ELSE 12 END WHEN p_size >= 10 THEN CASE WHEN c THEN 4 ELSE 8 END
  WHEN p_size >= 7 THEN CASE WHEN c THEN 3 ELSE 6 END ELSE CASE WHEN c THEN 2 ELSE 4 END END AS s FROM (SELECT *, p_partkey % 2 = 1 AS c FROM part))
""")
def b9_items_of_cards(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size")
    return p.select("p_partkey", C.items_of_card((F.col("p_partkey") % 13) / 2.0, "p_size", F.col("p_partkey") % 2 == 1).cast("int").alias("items"))


@query(f"""
WITH s AS (SELECT id, chapter_id, segment_index, character_name IS NOT NULL OR chapter_id % 2 = 0 AS ref, CAST(power(greatest(32, length(coalesce(text, ''))), 2) AS BIGINT) AS cost FROM ({_SEGMENTS})),
r AS (SELECT *, sum(cost) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, row_number() OVER (PARTITION BY chapter_id ORDER BY segment_index) - 1 AS k, sum(cost) OVER (PARTITION BY chapter_id) AS total,
 count(*) OVER (PARTITION BY chapter_id) >= 16 AND bool_and(ref) OVER (PARTITION BY chapter_id) AS able FROM s),
c AS (SELECT chapter_id, k AS cut FROM (SELECT chapter_id, k, row_number() OVER (PARTITION BY chapter_id ORDER BY abs(total / 2.0 - run), k) AS n FROM r WHERE k > 0) WHERE n = 1),
l AS (SELECT r.id, r.chapter_id, r.segment_index, CASE WHEN able AND r.k >= c.cut THEN 1 ELSE 0 END AS lane FROM r LEFT JOIN c ON c.chapter_id = r.chapter_id)
SELECT id, lane, CAST(row_number() OVER (PARTITION BY chapter_id, lane ORDER BY segment_index) - 1 AS INTEGER) AS lane_no FROM l
""")
def b11_parallel_lanes(spark, sf):
    """Two lanes for chapters of sixteen items or more that all have a reference recording."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text", "character_name").withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    s = s.withColumn("ref", F.when(F.col("character_name").isNotNull() | (F.col("chapter_id") % 2 == 0), "there"))
    return C.parallel_lanes(s, "chapter_id", "segment_index", "size", "ref").select("id", "lane", "lane_no")


@query(f"""
WITH s AS (SELECT id, coalesce(text, '') AS t, chapter_id, segment_index // 8 AS pack FROM ({_SEGMENTS})), f AS (SELECT *, bool_or(t LIKE '%?%') OVER (PARTITION BY chapter_id, pack) AS alone FROM s)
SELECT id, CASE WHEN t NOT LIKE '%?%' THEN CAST(length(t) AS VARCHAR) END AS result, CASE WHEN t LIKE '%?%' THEN 'no questions' END AS error, alone FROM f
""")
def b12_rendered_packs(spark, sf):
    """Packs of eight rendered by a stand-in that fails on questions: the rest of a failed pack is rendered one by one."""

    def call(texts: list[str]) -> list[str]:
        if any("?" in t for t in texts):
            raise ValueError("no questions")
        return [str(len(t)) for t in texts]

    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text").select("id", "chapter_id", F.floor(F.col("segment_index") / 8).alias("pack"), F.coalesce("text", F.lit("")).alias("text"))
    return C.rendered(s, ["chapter_id", "pack"], "id", "text", call).select("id", "result", "error", "alone")


@query(f"SELECT id, CAST(least(n, 12 * (1 + (segment_index + 6) // 12)) AS INTEGER) AS frontier FROM (SELECT s.id, s.segment_index, n.n FROM ({_SEGMENTS}) s JOIN ({_COUNTS}) n ON n.chapter_id = s.chapter_id)")
def b13_prewarm(spark, sf):
    """How far ahead segments are asked for while each is played."""
    return _segments(spark, sf, "id", "chapter_id", "segment_index").join(_counts(spark, sf), "chapter_id").select("id", C.prewarm_frontier("segment_index", "n").alias("frontier"))


@query(f"""
WITH s AS ({_SEGMENTS}), p AS (SELECT chapter_id, CAST(round(coalesce(duration_sec, 0.0) * 24000) AS BIGINT) + CASE WHEN lead(segment_index) OVER w IS NOT NULL THEN CAST(floor(24000 * CAST({_PAUSE_SQL} AS DOUBLE)) AS BIGINT) ELSE 0 END AS n
 FROM s WHERE audio_path IS NOT NULL WINDOW w AS (PARTITION BY chapter_id ORDER BY segment_index)), t AS (SELECT chapter_id, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1)
SELECT c.chapter_id, coalesce(t.n, 24000) AS samples FROM (SELECT DISTINCT chapter_id FROM s) c LEFT JOIN t ON t.chapter_id = c.chapter_id
""")
def k8_merged_samples(spark, sf):
    """The length of each chapter's merged recording, in samples."""
    s = _segments(spark, sf, "id", "chapter_id", "segment_index", "text", "ends_paragraph", "is_dialogue", "duration_sec", "audio_path")
    return C.merged_samples(s, ["chapter_id"], "segment_index")


@query("""SELECT id, CASE WHEN id % 6 NOT IN (0, 1) THEN printf('%.1f', -10.0 - id % 9) END AS input_i FROM chapters""")
def k9_loudness(spark, sf):
    """The last measurements in reports of a mastering pass; some reports have none, or values that are no numbers."""
    one = lambda v: F.format_string('{\n "input_i" : "%s", "input_tp" : "-1.0", "input_lra" : "5", "input_thresh" : "-30", "target_offset" : "0.1" }', v)
    k = F.col("id") % 6
    value = F.when(k == 1, "-inf").otherwise(F.format_string("%.1f", F.lit(-10.0) - F.col("id") % 9))
    report = F.when(k == 0, "no measurements").otherwise(F.concat(F.lit("size= 3kB "), one(F.lit("-99.0")), F.lit("\n[parsed]\n"), one(value), F.lit("\n")))
    return table(spark, sf, "chapters", "id").select("id", F.try_element_at(T.loudness(report), F.lit("input_i")).alias("input_i"))


_SAFE = f"regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace({{0}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_{_B}-]', '', 'g'), '^[{_B}]+|[{_B}]+$', '', 'g'), '[{_B}]+', '_', 'g'), 1, 80), '^$', 'export')"


def _safe(x: str) -> str:
    return _SAFE.format(x).replace("{{", "{").replace("}}", "}")


@query(f"""
WITH n AS (SELECT c.id, c.title, b.author, b.title AS book, row_number() OVER (PARTITION BY c.book_id ORDER BY c.order_num, c.id) AS n, c.book_id FROM chapters c JOIN books b ON b.id = c.book_id),
w AS (SELECT *, greatest(2, length(CAST(max(n) OVER (PARTITION BY book_id) AS VARCHAR))) AS w FROM n),
f AS (SELECT *, {_safe("lpad(CAST(n AS VARCHAR), CAST(w AS INTEGER), '0') || '_' || " + _safe("coalesce(title, '')"))} AS stem,
 coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif({_sql_strip('author')}, ''), 'Unknown') || ' - ' || coalesce(nullif({_sql_strip('book')}, ''), 'Untitled'), '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '[{_B}]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 160), ''), 'Unknown - Untitled') AS dir FROM w)
SELECT id, stem, dir || '/' || stem || '.wav' AS audio_path, dir || '/' || stem || '.ass' AS subtitle_path, CAST(n AS INTEGER) AS track FROM f
""")
def k5_manifest(spark, sf):
    """The files that an export of every chapter writes: numbered stems below the book's folder."""
    c = table(spark, sf, "chapters", "id", "book_id", "order_num", "title").join(table(spark, sf, "books", F.col("id").alias("book_id"), "author", F.col("title").alias("book_title")), "book_id")
    c = c.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("order_num", "id")))
    c = c.withColumn("width", F.greatest(F.lit(2), F.length(F.max("number").over(Window.partitionBy("book_id")).cast("string"))))
    return C.manifest(c).select("id", "stem", "audio_path", "subtitle_path", "track")


# ---------------------------------------------------------------- store


@query("SELECT id, CASE WHEN gender IS NULL THEN 'unknown' ELSE gender END AS gender, CASE WHEN gender IS NULL THEN upper(color_hex) ELSE color_hex END AS color_hex, name FROM characters")
def r21_named_update(spark, sf):
    """Characters without gender get one, and their colour in capitals; the name may not be set."""
    k = table(spark, sf, "characters", "id", "gender", "color_hex", "name")
    return R.set_columns(k, F.col("gender").isNull(), {"gender": "unknown", "color_hex": F.upper("color_hex"), "name": "x"}, ("instruct", "gender", "color_hex", "ref_text"))


@query("""
SELECT 'all' AS rule, 0 AS kept UNION ALL SELECT 'books', count(*) FROM tts_segments WHERE book_id NOT IN (SELECT id FROM books WHERE single_narrator_mode = 1)
UNION ALL SELECT 'chapters', count(*) FROM tts_segments s WHERE NOT EXISTS (SELECT 1 FROM speaker_annotations a WHERE a.source = 'manual' AND a.book_id = s.book_id AND a.chapter_id = s.chapter_id)
UNION ALL SELECT 'characters', count(*) FROM tts_segments s WHERE NOT EXISTS (SELECT 1 FROM tts_segments t JOIN characters k ON k.book_id = t.book_id AND k.name = t.character_name WHERE k.ref_audio_path IS NOT NULL AND t.book_id = s.book_id AND t.chapter_id = s.chapter_id)
UNION ALL SELECT 'default', count(*) FROM tts_segments WHERE book_id NOT IN (SELECT id FROM books WHERE narrator_instruct IS NULL)
""")
def r24_invalidation(spark, sf):
    """How many segments each kind of change leaves."""
    s = table(spark, sf, "tts_segments", "book_id", "chapter_id", "character_name")
    what = {
        "all": None,
        "books": table(spark, sf, "books", F.col("id").alias("book_id"), "single_narrator_mode").where("single_narrator_mode = 1"),
        "chapters": table(spark, sf, "speaker_annotations", "book_id", "chapter_id", "source").where("source = 'manual'"),
        "characters": table(spark, sf, "characters", "book_id", "name", "ref_audio_path").where("ref_audio_path is not null"),
        "default": table(spark, sf, "books", "id", "narrator_instruct"),
    }
    out = None
    for rule, w in what.items():
        part = R.kept_segments(s, rule, w).agg(F.count("*").alias("kept")).select(F.lit(rule).alias("rule"), "kept")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH b AS (SELECT id AS book_id FROM books WHERE id % 2 = 0), o AS ({_ANN}), m AS (SELECT * FROM o WHERE book_id IN (SELECT book_id FROM b) AND coalesce(source, 'automatic') = 'manual'),
n AS (SELECT book_id, chapter_id, unit_index, CASE WHEN speaker_name = '' THEN 'Somebody' ELSE speaker_name END AS speaker_name FROM o WHERE book_id IN (SELECT book_id FROM b)),
said AS (SELECT book_id, chapter_id, unit_index, speaker_name, 'manual' AS source FROM m UNION ALL SELECT n.*, 'automatic' FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chapter_id = n.chapter_id AND m.unit_index = n.unit_index)),
kept AS (SELECT book_id, name FROM characters k WHERE book_id IN (SELECT book_id FROM b) AND EXISTS (SELECT 1 FROM m WHERE m.book_id = k.book_id AND m.speaker_name <> '' AND m.speaker_name = k.name)),
cast_ AS (SELECT book_id, name FROM kept UNION SELECT DISTINCT book_id, speaker_name FROM n)
SELECT 'annotations' AS what, count(*) AS n, sum(CASE WHEN source = 'manual' THEN 1 ELSE 0 END) AS k FROM (SELECT source FROM said UNION ALL SELECT coalesce(source, 'automatic') FROM o WHERE book_id NOT IN (SELECT book_id FROM b))
UNION ALL SELECT 'characters', count(*), sum(f) FROM (SELECT c.book_id, (SELECT count(*) FROM said WHERE said.book_id = c.book_id AND {_FOLD.format('said.speaker_name')} = {_FOLD.format('c.name')}) AS f FROM cast_ c UNION ALL SELECT book_id, frequency FROM characters WHERE book_id NOT IN (SELECT book_id FROM b))
UNION ALL SELECT 'segments', count(*), 0 FROM tts_segments WHERE book_id NOT IN (SELECT book_id FROM b)
""")
def k2_stored_analysis(spark, sf):
    """Books with even ids analysed again (narration goes to Somebody): rows of each table, manual annotations, sum of frequencies."""
    b = table(spark, sf, "books", F.col("id").alias("book_id")).where("book_id % 2 = 0")
    old = _annotations(spark, sf, "book_id", "speaker_name", "source").drop("id")
    new = old.join(b, "book_id", "left_semi").select("book_id", "chapter_id", "unit_index", F.when(F.col("speaker_name") == "", "Somebody").otherwise(F.col("speaker_name")).alias("speaker_name"))
    cast = new.select("book_id", F.col("speaker_name").alias("name")).distinct()
    got = R.store_analysis(b, table(spark, sf, "characters", "book_id", "name", "frequency"), old, table(spark, sf, "tts_segments", "book_id", "chapter_id"), cast, new)
    one = got["speaker_annotations"].agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce("source", F.lit("automatic")) == "manual", 1).otherwise(0)).cast("long").alias("k")).select(F.lit("annotations").alias("what"), "n", "k")
    two = got["characters"].agg(F.count("*").alias("n"), F.sum("frequency").cast("long").alias("k")).select(F.lit("characters").alias("what"), "n", "k")
    three = got["tts_segments"].agg(F.count("*").alias("n")).select(F.lit("segments").alias("what"), "n", F.lit(0).cast("long").alias("k"))
    return one.unionByName(two).unionByName(three)


# ---------------------------------------------------------------- analysis, corrections, enrichment


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """The annotated units, spoken ones as candidates."""
    a = _annotations(spark, sf, "book_id", "unit_text", "speaker_name")
    return a.select("chapter_id", "unit_index", F.coalesce("unit_text", F.lit("")).alias("unit_text"), (F.col("speaker_name") != "").alias("dialogue_candidate"), "speaker_name")


_PACKS_SQL = f"""
a AS MATERIALIZED ({_ANN}), z AS (SELECT chapter_id, sum(length(coalesce(unit_text, ''))) AS size FROM a GROUP BY 1),
s AS MATERIALIZED (SELECT c.book_id, c.id AS chapter_id, c.order_num, c.title, CAST(z.size AS BIGINT) AS size, row_number() OVER (PARTITION BY c.book_id ORDER BY c.order_num, c.id) AS k FROM chapters c JOIN z ON z.chapter_id = c.id),
u AS (SELECT book_id, chapter_id, order_num, title, size, k, size AS run, 0 AS pack_no FROM s WHERE k = 1 UNION ALL
 SELECT s.book_id, s.chapter_id, s.order_num, s.title, s.size, s.k, CASE WHEN u.run + s.size > 10000 THEN s.size ELSE u.run + s.size END, CASE WHEN u.run + s.size > 10000 THEN u.pack_no + 1 ELSE u.pack_no END FROM u JOIN s ON s.book_id = u.book_id AND s.k = u.k + 1)
"""


@query(f"WITH RECURSIVE {_PACKS_SQL} SELECT book_id, chapter_id, size, pack_no FROM u")
def g14_batches(spark, sf):
    """The chapters of each book in batches of at most 10,000 characters of units."""
    c = table(spark, sf, "chapters", F.col("id").alias("chapter_id"), "book_id", "order_num")
    return A.batches(_units(spark, sf), c).select("book_id", "chapter_id", "size", "pack_no")


@query(f"""
WITH RECURSIVE {_PACKS_SQL}, n AS (SELECT u.book_id, u.pack_no, u.chapter_id, u.order_num, u.title, row_number() OVER (PARTITION BY u.book_id, u.pack_no ORDER BY u.order_num, u.chapter_id, a.unit_index) - 1 AS rid, a.speaker_name <> '' AS d, coalesce(a.unit_text, '') AS t FROM a JOIN u ON u.chapter_id = a.chapter_id),
b AS (SELECT book_id, pack_no, chapter_id, order_num, chr(10) || '=== CHAPTER: ' || coalesce(title, '') || ' ===' || chr(10) || string_agg('[' || CASE WHEN d THEN 'D' ELSE 'N' END || ' ' || CAST(rid AS VARCHAR) || '] ' || t, chr(10) ORDER BY rid) AS block FROM n GROUP BY book_id, pack_no, chapter_id, order_num, title)
SELECT book_id, pack_no, md5(string_agg(block, chr(10) ORDER BY order_num, chapter_id)) AS digest FROM b GROUP BY 1, 2
""")
def g15_prompts(spark, sf):
    """The numbered units of each batch as a prompt shows them."""
    c = table(spark, sf, "chapters", F.col("id").alias("chapter_id"), "book_id", "order_num", "title")
    u = _units(spark, sf)
    lines = A.numbered(u, A.batches(u, c))
    return A.prompt_texts(lines, c).select("book_id", "pack_no", F.md5("prompt_units").alias("digest"))


@query("""
SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '{"dialogues":["1|A"]}' WHEN 4 THEN '{"dialogues":["2|B"]}' ELSE NULL END AS body,
 CASE id % 6 WHEN 0 THEN 'no message' WHEN 1 THEN 'empty' WHEN 2 THEN 'only reasoning' WHEN 5 THEN 'invalid' END AS problem FROM books
""")
def l2_unwrapped_replies(spark, sf):
    """Chat replies of several shapes: without message, empty, thoughts only, fenced, in parts, broken."""
    shapes = (
        '{"error": 1}', '{"choices": [{"message": {"content": "  "}}]}', '{"choices": [{"message": {"content": "", "reasoning_content": "hm"}}]}',
        '{"choices": [{"message": {"content": "```json\\n{\\"dialogues\\":[\\"1|A\\"]}\\n```"}}]}',
        '{"choices": [{"message": {"content": [{"text": "{\\"dialogues\\":"}, {"text": "[\\"2|B\\"]}"}]}}]}', '{"choices": [{"message": {"content": "{broken"}}]}',
    )
    b = table(spark, sf, "books", "id").withColumn("reply", F.element_at(F.array(*map(F.lit, shapes)), (F.col("id") % 6 + 1).cast("int")))
    return b.select("id", A.unwrapped("reply").alias("u")).select("id", "u.body", "u.problem")


@query(f"WITH a AS ({_ANN}) SELECT chapter_id, count(DISTINCT unit_index) AS valid FROM a WHERE speaker_name NOT IN ('', 'Narrator', 'Unknown') AND unit_index % 2 = 0 AND {_sql_strip('speaker_name')} <> '' GROUP BY chapter_id")
def l6_coverage(spark, sf):
    """How many of the candidates (every second unit) the replies of each chapter name a speaker for."""
    a = _annotations(spark, sf, "speaker_name")
    said = F.concat(F.lit(" "), F.col("unit_index").cast("string"), F.lit(" | "), F.coalesce("speaker_name", F.lit("")))
    reply = a.groupBy("chapter_id").agg(F.to_json(F.struct(F.collect_list(said).alias("dialogues"))).alias("reply"))
    return A.coverage(reply, "chapter_id", "reply", a.where("unit_index % 2 = 0").select("chapter_id", F.col("unit_index").alias("unit_id")))


def _stand_in(prompt: str) -> dict:
    """A model for tests: a spoken unit that names somebody before a verb of speech is theirs."""
    import re

    said, people = [], {}
    for m in re.finditer(r"^\[D (\d+)\] (.*)$", prompt, re.M):
        hit = re.search(rf"({P.NAME})\s+(?:{P.SAID})", m[2])
        if hit:
            said.append(f"{m[1]}|{hit[1]}")
            people[hit[1]] = {"name": hit[1], "gender": "unknown", "aliases": []}
    return {"dialogues": said, "characters": list(people.values())}


@query()
def l11_analysis(spark, sf):
    """The whole analysis of all books with a stand-in for the model: the cast of each book."""
    c = table(spark, sf, "chapters", F.col("id").alias("chapter_id"), "book_id", "order_num", "title", "content")
    return A.analyse(_units(spark, sf), c, _stand_in)["characters"].select("book_id", "name", "gender", "frequency", "instruct", "color_hex")


@query(f"""
WITH w AS (SELECT DISTINCT book_id, speaker_name AS name FROM speaker_annotations WHERE speaker_name <> ''), k AS (SELECT book_id, {_FOLD.format('name')} AS f, min_by(name, id) AS stored, min(id) AS id FROM characters GROUP BY 1, 2)
SELECT w.book_id, w.name, coalesce(k.stored, w.name) AS canonical, k.id FROM w LEFT JOIN k ON k.book_id = w.book_id AND k.f = {_FOLD.format('w.name')}
""")
def c2_found_or_created(spark, sf):
    """The character each annotated name means; names the cast lacks become new ones."""
    w = table(spark, sf, "speaker_annotations", "book_id", F.col("speaker_name").alias("name"))
    k = table(spark, sf, "characters", "id", "book_id", "name", "gender", "instruct", "color_hex")
    return S.find_or_create(k, w).select("book_id", "name", "canonical", "id")


@query(f"""
WITH a AS (SELECT chapter_id, unit_index, speaker_name AS sp, CASE WHEN unit_index % 5 = 4 THEN NULL ELSE unit_index // 3 END AS turn, unit_index % 4 <> 3 AS cand FROM ({_ANN})),
c AS (SELECT chapter_id, 1 AS here, ['sentence', 'turn', 'turn_tail', 'range'][CAST(chapter_id % 4 AS INTEGER) + 1] AS scope, CASE WHEN chapter_id % 3 = 0 THEN '' ELSE coalesce(max(CASE WHEN unit_index = 3 THEN sp END), '') END AS who, 2 AS hi FROM a GROUP BY chapter_id),
r AS (SELECT a.*, c.here, c.scope, c.who, c.hi, t.turn AS t FROM a JOIN c ON c.chapter_id = a.chapter_id JOIN a t ON t.chapter_id = a.chapter_id AND t.unit_index = c.here),
x AS (SELECT *, CASE scope WHEN 'sentence' THEN unit_index = here WHEN 'turn' THEN coalesce(turn = t AND cand, false) OR (t IS NULL AND unit_index = here) WHEN 'turn_tail' THEN (coalesce(turn = t AND cand, false) OR (t IS NULL AND unit_index = here)) AND unit_index >= here ELSE unit_index BETWEEN here AND hi END AS chosen,
 scope = 'range' AND who <> '' AND unit_index > hi AS tail FROM r),
y AS (SELECT *, min(CASE WHEN tail AND lower(trim(coalesce(sp, ''))) <> lower(who) THEN unit_index END) OVER (PARTITION BY chapter_id) AS stop FROM x)
SELECT chapter_id, unit_index, CASE WHEN chosen THEN who ELSE '' END AS speaker_name, CAST(1.0 AS DOUBLE) AS confidence, 'manual' AS source FROM y WHERE chosen OR (tail AND (stop IS NULL OR unit_index < stop))
""")
def c1_corrections(spark, sf):
    """One correction a chapter, of all four scopes: the manual annotations they make, the cleared run behind a range included."""
    a = _annotations(spark, sf, "speaker_name")
    u = a.select("chapter_id", "unit_index", F.when(F.col("unit_index") % 5 != 4, F.floor(F.col("unit_index") / 3)).alias("turn_index"), (F.col("unit_index") % 4 != 3).alias("dialogue_candidate"), F.col("speaker_name").alias("effective_speaker"))
    third = F.coalesce(F.max(F.when(F.col("unit_index") == 3, F.col("speaker_name"))), F.lit(""))
    scope = F.element_at(F.array(*map(F.lit, ("sentence", "turn", "turn_tail", "range"))), (F.col("chapter_id") % 4 + 1).cast("int"))
    c = a.groupBy("chapter_id").agg(third.alias("who")).select("chapter_id", F.lit(1).alias("at"), scope.alias("scope"), F.when(F.col("chapter_id") % 3 == 0, "").otherwise(F.col("who")).alias("speaker"), F.lit(2).alias("end"))
    return S.corrections(u, c)


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    c = spread(table(spark, sf, "chapters", F.col("id").alias("chapter_id"), "book_id", "title", "content"), "chapter_id")
    b = table(spark, sf, "books", F.col("id").alias("book_id"), "narrator_instruct", "single_narrator_mode")
    return E.enrich(c, b, table(spark, sf, "characters", "book_id", "name", "instruct"), _annotations(spark, sf, "speaker_name").drop("id"))


@query()
def g11_enriched_segments(spark, sf):
    """All chapters as the segments that are spoken."""
    return _enriched(spark, sf)


@query()
def r23_stale_segments(spark, sf):
    """Chapters whose stored segments differ from those made anew of their text, in any of nine columns or in number."""
    stored = _segments(spark, sf, "id", "chapter_id", "segment_index", *E.COMPARED)
    return R.stale_keys(E.comparable(stored), E.comparable(_enriched(spark, sf)), ["chapter_id"], "segment_index", list(E.COMPARED))
