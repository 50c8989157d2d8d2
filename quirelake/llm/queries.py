"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, spread, table
from . import encoding, language, leaks, mixing, names, pieces, scans, sentences, subjects, textform

_CHAPTERS = ("id", "content")


def _p1(spark: SparkSession, sf: str) -> tuple[DataFrame, encoding.Plausibility]:
    parts = [("chapters", "content"), ("characters", "name")]
    fields = [spread(table(spark, sf, t, "id", c), "id").select(F.lit(t).alias("src"), F.col("id").alias("row_id"), F.col(c).alias("text")) for t, c in parts]
    rows = fields[0].unionByName(fields[1])
    return rows, encoding.learn((rows, "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, model = _p1(spark, sf)
    return encoding.garbled(rows, ["src", "row_id"], "text", model)


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged rows with their text given back; lost_words counts what is past repair."""
    rows, model = _p1(spark, sf)
    return encoding.repaired(rows, ["src", "row_id"], "text", model)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    cut = pieces.piece_table(chapters, "id", "content", with_text=False)
    return cut.where("n_pieces > 1 and piece_no = 0").select(F.col("id").alias("chapter_id"))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    return pieces.piece_table(chapters, "id", "content").withColumnRenamed("id", "chapter_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    pairs = textform.print_alike_pairs(chapters, "id", "content")
    return pairs.select(F.col("a").alias("chapter_id_a"), F.col("b").alias("chapter_id_b"))


def p3_normalized(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    return textform.normalized(chapters, "id", "content").withColumnRenamed("id", "chapter_id")


def _p4_passages(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "books", "id", "language").select(F.col("id").alias("book_id"), language.label_expr("language").alias("label"))
    chapters = table(spark, sf, "chapters", "id", "book_id", "content")
    model = language.learn(chapters, "id", "content", books, "book_id", "label")
    return language.passage_table(spread(chapters, "id"), "id", "content", model, "book_id")


def _p4_books(passages: DataFrame) -> DataFrame:
    """Main language of each book: the one most of its text is in."""
    size = passages.groupBy("book_id", "lang").agg(F.sum("sentences").alias("size"), F.sum(F.col("confidence") * F.col("sentences")).alias("sure"))
    top = size.groupBy("book_id").agg(F.max(F.struct("size", "lang", "sure")).alias("top"), F.sum("size").alias("total"))
    return top.select("book_id", "top.lang", (F.col("top.sure") / F.col("total")).alias("confidence"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    passages = durable(_p4_passages(spark, sf))
    label = table(spark, sf, "books", "id", "language").select(F.col("id").alias("book_id"), language.label_expr("language").alias("label"))
    wrong = _p4_books(passages).join(label, "book_id").where("label is null or label <> lang")
    # a chapter with a foreign passage counts for each of its languages, the main one included
    mixed = passages.where("sentences >= 3 and lang <> main_lang").select("id", F.explode(F.array("lang", "main_lang")).alias("lang")).distinct()
    return wrong.select(F.lit("books").alias("src"), F.col("book_id").alias("row_id"), "lang").unionByName(
        mixed.select(F.lit("chapters").alias("src"), F.col("id").alias("row_id"), "lang")
    )


def p4_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _p4_passages(spark, sf).withColumnRenamed("id", "chapter_id")


def p4_books(spark: SparkSession, sf: str) -> DataFrame:
    return _p4_books(_p4_passages(spark, sf))


def _p5(spark: SparkSession, sf: str) -> tuple[DataFrame, encoding.Plausibility]:
    cast = table(spark, sf, "characters", "book_id", "name")
    said = table(spark, sf, "speaker_annotations", "book_id", F.col("speaker_name").alias("name"))
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    return cast.unionByName(said), encoding.learn((chapters, "content"), (cast, "name"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    names_, model = _p5(spark, sf)
    return names.variant_pairs(names_, "book_id", "name", model)


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with the class of the person or organisation it names: the same links without all pairs."""
    names_, model = _p5(spark, sf)
    return names.variant_classes(names_, "book_id", "name", model)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    return scans.damaged(chapters, "id", "content").select(F.col("id").alias("chapter_id"))


def p6_mended(spark: SparkSession, sf: str) -> DataFrame:
    chapters = spread(table(spark, sf, "chapters", *_CHAPTERS), "id")
    return scans.mended(chapters, "id", "content").withColumnRenamed("id", "chapter_id")


def _of_books(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters of the given books; their ids are broadcast only if they were counted to be few."""
    ids = books.select(F.col("id").alias("book_id"))
    return chapters.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "book_id", "left_semi")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    epub = table(spark, sf, "books", "id", "file_type").where("file_type = 'epub'")
    chapters = _of_books(table(spark, sf, "chapters", "id", "book_id", "content"), epub).select("id", "content")
    units = table(spark, sf, "speaker_annotations", "id", "unit_text")
    parts = [
        sentences.sentence_starts(spread(df, "id"), "id", text).select(F.lit(src).alias("src"), F.col("id").alias("row_id"), "start_pos")
        for src, df, text in (("chapters", chapters, "content"), ("speaker_annotations", units, "unit_text"))
    ]
    return parts[0].unionByName(parts[1])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = leaks.leaked(
        table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items", "item_id", "text"),
        seed=12, min_tile=5, min_run=12, min_coverage=2.0,
    )
    return pairs.select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of every pair, also of items of which only the order of passages was changed."""
    return leaks.leaked(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items", "item_id", "text"))


def _p9(spark: SparkSession, sf: str) -> tuple[DataFrame, list[dict]]:
    return mixing.mixture(table(spark, sf, "documents", "doc_id", "text", "source"), table(spark, sf, "mix_targets", "source", "target_share", "max_repeats"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _p9(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_p9(spark, sf))


def _p10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    model = subjects.learn(docs, table(spark, sf, "subject_labels", "doc_id", "subject"), table(spark, sf, "subjects", "subject"), table(spark, sf, "eval_items", "text"))
    return subjects.assign(docs, model)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p10(spark, sf).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each subject in the corpus, by documents and by sentences."""
    total = table(spark, sf, "documents", "doc_id").count()
    got = _p10(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"), F.sum(F.col("part") * F.col("sentences")).alias("sentences"))
    return got.withColumn("share", F.col("documents") / F.lit(max(total, 1)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit() and callable(f)}


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''")


def _sql_words(text: str) -> str:
    """Blank-separated strings reduced to letters and digits, without case and Unicode form."""
    form = f"lower(nfc_normalize(replace(replace(translate({text}, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')))"
    return f"list_filter(list_transform(regexp_split_to_array({form}, '[\\s\\p{{Z}}]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


def _sql_runs(table_: str, key: str) -> str:
    words = f"SELECT {key}, {_sql_words('text')} AS w FROM {table_} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM ({words}) WHERE len(w) >= 12)"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT id AS chapter_id FROM chapters WHERE length(content) > 6000",
        "p8_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_sql_runs('documents', 'doc_id')}) d JOIN ({_sql_runs('eval_items', 'item_id')}) i ON d.g = i.g",
    }
