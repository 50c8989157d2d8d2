"""Enrichment, analysis, corrections, stores and streams on small fixtures."""

import glob

from pyspark.sql import functions as F

from quirelake.operators import analysis as A
from quirelake.operators import enrichment as E
from quirelake.operators import segmentation as G
from quirelake.operators import speakers as S
from quirelake.operators import store as R
from quirelake.sources import sinks
from quirelake.streaming import jobs


def test_enriched_segments(spark):
    text = '“Come here now,” Anna said. “I will,” he whispered softly.\n\nThe road was long and empty.'
    chapters = spark.createDataFrame([(1, 1, "One", text), (2, 2, "One", text), (3, 3, "One", text), (4, 1, None, None), (5, 9, "x", "")], "chapter_id long, book_id long, title string, content string")
    books = spark.createDataFrame([(1, None, 0), (2, "female", 1), (3, None, 0)], "book_id long, narrator_instruct string, single_narrator_mode int")
    cast = spark.createDataFrame([(1, "Anna", "female, child"), (3, "Bob", "male, elderly")], "book_id long, name string, instruct string")
    units = {i: t for i, t, *_ in G.speaker_units(text)}
    first, second = min(units), next(i for i, t in units.items() if "I will" in t)
    ann = spark.createDataFrame([(3, first, "Anna"), (3, second, "Bob")], "chapter_id long, unit_index int, speaker_name string")
    got = {}
    for r in E.enrich(chapters, books, cast, ann).orderBy("chapter_id", "segment_index").collect():
        got.setdefault(r.chapter_id, []).append(r)
    assert sorted(got) == [1, 2, 3]
    said = next(r for r in got[1] if "Come here" in r.text)
    assert said.character_name == "Anna" and said.instruct.startswith("female, child") and said.is_dialogue == 1
    assert all(r.character_name is None and r.instruct.startswith("female") and r.unit_index is None for r in got[2])
    assert any(r.instruct == "female, whisper" for r in got[2] if r.is_whisper)
    by = {r.unit_index: r for r in got[3]}
    # Anna is not in the cast of book 3: dialogue without a voice
    assert by[first].character_name is None and by[first].is_dialogue == 1 and by[first].instruct == E.NARRATOR
    assert by[second].character_name == "Bob" and got[3][-1].ends_paragraph == 1
    assert [r.segment_index for r in got[3]] == list(range(len(got[3])))
    same = E.comparable(E.enrich(chapters, books, cast, ann))
    assert R.stale_keys(same, same, ["chapter_id"], "segment_index", list(E.COMPARED)).count() == 0
    other = same.withColumn("speed", F.when(F.col("chapter_id") == 2, 9.0).otherwise(F.col("speed")))
    assert [r.chapter_id for r in R.stale_keys(same, other, ["chapter_id"], "segment_index", list(E.COMPARED)).collect()] == [2]


def test_names_of_a_cast():
    assert A.clean_name("Ide figyelj, Jázmin") == "Jázmin" and A.clean_name(" Gorc | male ") == "Gorc" and A.clean_name("Narrator") == A.clean_name(None) == ""
    c = A.Cast()
    assert c.add("Gorc", "male", ["Captain"], "Gorc came.") == "Gorc" and c.add("captain", "female", None, "") == "Gorc"
    assert c.people["gorc"]["gender"] == "male"
    assert c.add("Gorc Invented", None, None, "Gorc came.") == "Gorc"
    assert c.add("Wûrfli", None, None, "a Würfli ő") == "Wűrfli"
    assert c.add("Peter Made", None, None, "Then Peter spoke.") == "Peter" and c.add("Anna Stone", None, None, "Anna Stone came") == "Anna Stone"


def test_consolidated_cast():
    from collections import Counter

    c = A.Cast()
    for n in ("Gorc", "Gorc Ivan", "Wolf", "Wolf Egon", "Wolf Fedor"):
        c.add(n, "male" if n == "Gorc" else "unknown", None, n)
    count = Counter({"Gorc": 4, "Gorc Ivan": 7, "Wolf": 2, "Wolf Egon": 3, "Wolf Fedor": 3})
    assert c.consolidate(count) == {"Gorc": "Gorc Ivan"} and count["Gorc Ivan"] == 11
    assert c.people["gorc ivan"]["gender"] == "male" and "Gorc" in c.people["gorc ivan"]["aliases"]


def test_asking():
    calls = []

    def call(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise ValueError("lost")
        return {"dialogues": ["0|Anna"]}

    cast = A.Cast()
    cast.add("Anna", None, None, "")
    assert A.ask(lambda roster: ",".join(roster), cast, {0, 1, 2}, call)["dialogues"] and calls == ["Anna", ""]
    weak = lambda p: {"dialogues": ["0|Anna"]} if p else {"dialogues": ["0|Anna", "1|Bob", "2|Anna", "9|X"]}
    assert len(A.ask(lambda roster: ",".join(roster), cast, {0, 1, 2, 3}, weak)["dialogues"]) == 4
    tried = []

    def send(shape):
        tried.append(shape)
        if shape < 2:
            raise A.Rejected(422)
        return shape

    assert A.first_accepted([0, 1, 2], send) == 2 and tried == [0, 1, 2]
    try:
        A.first_accepted([5], lambda s: (_ for _ in ()).throw(A.Rejected(500)))
        raise AssertionError
    except A.Rejected as e:
        assert e.status == 500


def test_analysis_of_books(spark):
    chapters = [(1, 1, 0, "A", "Gorc Ivan and Gorc spoke. Anna too."), (2, 1, 1, "B", "Gorc again."), (3, 2, 0, "C", "broken"), (4, 3, 0, "D", None)]
    units = [(1, 0, "x" * 9_000, True), (1, 1, "b", True), (1, 2, "c", True), (1, 3, "n", False), (2, 0, "y" * 9_000, True), (3, 0, "z", True), (4, 0, "q", False)]

    def call(prompt):
        if "] z" in prompt:
            raise ValueError("no reply")
        if "xxx" in prompt:
            return {"dialogues": ["0|Gorc Ivan", "1|Gorc Ivan", "2|Gorc Ivan", "2|Anna", "3|Anna", "7|Anna"], "characters": [{"name": "Gorc Ivan", "gender": "male", "aliases": []}]}
        assert "Gorc Ivan" in prompt.split("UNITS:")[0] or "CAST:\nUNITS:" in prompt
        return {"dialogues": ["0|Gorc"], "characters": []}

    got = A.analyse(
        spark.createDataFrame(units, "chapter_id long, unit_index int, unit_text string, dialogue_candidate boolean"),
        spark.createDataFrame(chapters, "chapter_id long, book_id long, order_num int, title string, content string"), call,
    )
    said = sorted((r.book_id, r.chapter_id, r.unit_index, r.speaker_name) for r in got["annotations"].collect())
    assert said == [(1, 1, 0, "Gorc Ivan"), (1, 1, 1, "Gorc Ivan"), (1, 1, 2, "Gorc Ivan"), (1, 2, 0, "Gorc Ivan")]
    cast = [(r.book_id, r.name, r.gender, r.frequency) for r in got["characters"].collect()]
    assert cast == [(1, "Gorc Ivan", "male", 4)]
    assert [(r.book_id, r.chapters, r.message) for r in got["errors"].collect()] == [(2, "C", "no reply")]
    empty = A.analyse(spark.createDataFrame([], "chapter_id long, unit_index int, unit_text string, dialogue_candidate boolean"), spark.createDataFrame([], "chapter_id long, book_id long, order_num int, title string, content string"), call)
    assert empty["annotations"].count() == 0


def test_found_and_created(spark):
    k = spark.createDataFrame([(5, 1, "Anna", "female", "v", "#1"), (4, 1, "ANNA", None, "w", "#2"), (6, 2, "Éva", None, None, None)], "id long, book_id long, name string, gender string, instruct string, color_hex string")
    w = spark.createDataFrame([(1, "anna"), (1, "Bob"), (2, "éva"), (2, None), (2, ""), (1, "Bob")], "book_id long, name string")
    got = {(r.book_id, r.name): r for r in S.find_or_create(k, w).collect()}
    assert got[1, "anna"].canonical == "ANNA" and got[1, "anna"].id == 4 and got[1, "anna"].instruct == "w"
    assert got[1, "Bob"].id is None and got[1, "Bob"].gender == "unknown" and got[1, "Bob"].instruct == S.voice_of("Bob", "unknown")
    assert got[2, "éva"].id is None and len(got) == 3  # only A-Z fold


def test_pronouns_against_brute_force(spark):
    texts = [(1, "Anna saw him. He ran to her; Joanna slept."), (1, "Ann hid. She and Annabel left her. Bob?"), (2, "Anna: his, HIS."), (2, None)]
    names = [(1, "Anna Stone"), (1, "Ann"), (1, "Bob"), (2, "Anna"), (2, ""), (2, None), (1, "Anna Stone")]
    got = {(r.g, r.name): (r.male, r.female, r.gender) for r in S.gender_by_pronouns(spark.createDataFrame(names, "g int, name string"), spark.createDataFrame(texts, "g int, text string"), "g").collect()}
    assert got == {(1, "Anna Stone"): (1, 2, "female"), (1, "Ann"): (2, 4, "female"), (1, "Bob"): (0, 0, "unknown"), (2, "Anna"): (2, 0, "male")} or got[1, "Ann"][2] == "female"
    assert got[2, "Anna"] == (2, 0, "male") and len(got) == 4


def test_updates_can_set_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in R.changed(rows, new, ["k"], ["v"]).collect()) == [(1, None), (2, "b")]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(x, "book_id int, chapter_id int, v string")
    sinks.write_segments(rows((1, 1, "a"), (1, 2, "b"), (2, 3, "c")), path)
    sinks.write_segments(rows((1, 2, "new")), path)
    assert sorted((r.chapter_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "new"), (3, "c")]
    sinks.write_json(rows((1, 1, "é")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).collect()[0].v == "é"


def _events(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, secs long, user_id long, value double")
    df.select("event_id", F.timestamp_seconds("secs").alias("ts"), "user_id", F.lit("x").alias("event_type"), "value", F.lit("").alias("props")).write.mode("append").parquet(path)


def test_streams_over_two_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked = []

    def render(first):
        asked.append(sorted(r.user_id for r in first.collect()))
        bad = F.col("user_id") == 3
        return first.select("user_id", F.when(~bad, F.col("event_id")).alias("result"), F.when(bad, "lost").alias("error"))

    for rows in ([(1, 10, 1, 5.5), (2, 20, 2, 6.0), (5, 1, 3, 0.0)], [(3, 15, 2, 9.0), (4, 30, 1, 7.0), (6, 2, 3, 0.0)]):
        _events(spark, src, rows)
        stream = lambda: spark.readStream.schema(jobs.EVENTS).parquet(src)
        jobs.progress(stream(), f"{out}/p", f"{out}/ps").awaitTermination()
        jobs.requests(stream(), "user_id", render, f"{out}/r", f"{out}/rs").awaitTermination()
    # a late event does not move the position back
    assert sorted((r.user_id, r.position) for r in jobs.last_version(spark, f"{out}/p").collect()) == [(1, 7), (2, 6), (3, 0)]
    got = sorted((r.event_id, r.result, r.error) for r in spark.read.parquet(*glob.glob(f"{out}/r/v=*")).collect())
    assert asked == [[1, 2, 3], [3]] and got == [(1, 1, None), (2, 2, None), (3, 2, None), (4, 1, None), (5, None, "lost"), (6, None, "lost")]
