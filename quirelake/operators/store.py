"""Changes to the library tables, expressed as new versions of them: joins, anti-joins and unions.

Files are immutable, so an update is a rewrite of the partitions it touches. There is no transaction over several
tables; callers write the new versions and then swap them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace the rows of ``old`` with equal keys; the rest stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds the rows of ``new`` whose keys ``old`` lacks, the first by ``order`` of each key."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_where_in(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def cascade(doomed: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What is left of each child table when the parents go."""
    return {name: delete_where_in(df, doomed, [key]) for name, df in children.items()}


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_by_priority(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The first of several sources that has a row for the key, its first row by ``order``."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return latest(out, keys, [F.col("_p"), *map(F.col, order)]).drop("_p")


def stale_keys(stored: DataFrame, made: DataFrame, group: list[str], index: str, columns: list[str]) -> DataFrame:
    """Groups whose stored rows differ from freshly made ones in any column or in number."""
    a = stored.select(*group, index, F.struct(*columns).alias("a"))
    b = made.select(*group, index, F.struct(*columns).alias("b"))
    both = a.join(b, [*group, index], "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy(*group).agg(F.count("*").alias("mismatches"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows for."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def changed(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Batched update: the columns of a row with equal keys in ``changes`` replace those of the row, nulls included."""
    new = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, keys, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_{c}" for c in columns])


def set_columns(rows: DataFrame, which: Column, values: dict[str, object], allowed: tuple[str, ...]) -> DataFrame:
    """Sets the named columns of the chosen rows; columns that may not be set are left out, and nothing to set is an error."""
    todo = {c: v for c, v in values.items() if c in allowed}
    if not todo:
        raise ValueError("nothing to update")
    return rows.withColumns({c: F.when(which, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in todo.items()})


def kept_segments(segments: DataFrame, rule: str, what: DataFrame | None = None) -> DataFrame:
    """What a change leaves of the segments.

    'all': a policy or a setting of the audio changed; 'books': a book's narrator, mode or reference text changed (``what`` has
    book_id); 'chapters': a chapter's speakers were corrected (book_id, chapter_id); 'characters': a voice changed (book_id, name);
    'default': the default narrator changed (``what`` has id and narrator_instruct of all books).
    """
    if rule == "all":
        return segments.limit(0)
    if rule == "default":
        return delete_where_in(segments, what.where("narrator_instruct is null").select(F.col("id").alias("book_id")), ["book_id"])
    if rule == "characters":
        hit = segments.join(what.select("book_id", F.col("name").alias("character_name")).distinct(), ["book_id", "character_name"], "left_semi")
        return delete_where_in(segments, hit, ["book_id", "chapter_id"])
    return delete_where_in(segments, what, {"books": ["book_id"], "chapters": ["book_id", "chapter_id"]}[rule])


def store_analysis(
    books: DataFrame, characters: DataFrame, annotations: DataFrame, segments: DataFrame, new_characters: DataFrame, new_annotations: DataFrame,
) -> dict[str, DataFrame]:
    """New versions of characters, annotations and segments after the books of ``books`` (book_id) were analysed again.

    Manual annotations and the characters they name stay, what was found is added where its key is free, frequencies are counted anew,
    the segments of these books go. Other books are left as they are.
    """
    mine = lambda df: df.join(books.select("book_id").distinct(), "book_id", "left_semi")
    rest = lambda df: df.join(books.select("book_id").distinct(), "book_id", "left_anti")
    manual = mine(annotations).where(F.coalesce("source", F.lit("automatic")) == "manual")
    said = manual.unionByName(
        latest(mine(new_annotations), ["chapter_id", "unit_index"], [F.col("speaker_name")]).withColumn("source", F.lit("automatic")).join(manual.select("chapter_id", "unit_index"), ["chapter_id", "unit_index"], "left_anti"),
        allowMissingColumns=True,
    )
    named = manual.where("speaker_name <> ''").select("book_id", F.col("speaker_name").alias("name"))
    cast = insert_or_ignore(mine(characters).join(named, ["book_id", "name"], "left_semi"), mine(new_characters), ["book_id", "name"], [F.col("name")])
    fold = lambda c: T.fold_ascii(c)
    n = said.groupBy("book_id", fold("speaker_name").alias("_k")).agg(F.count("*").alias("_n"))
    cast = cast.withColumn("_k", fold("name")).join(n, ["book_id", "_k"], "left").withColumn("frequency", F.coalesce("_n", F.lit(0)).cast("int")).drop("_k", "_n")
    return {"characters": rest(characters).unionByName(cast, allowMissingColumns=True), "speaker_annotations": rest(annotations).unionByName(said, allowMissingColumns=True), "tts_segments": rest(segments)}
