import re

import __spark_entry__ as entry
from quirelake.operators import speakers as S
from quirelake.operators import store as R


def test_turns(spark):
    rows = [(1, 0, 0, "X"), (1, 1, 0, None), (1, 2, 1, "A"), (1, 3, 1, "B"), (1, 4, 1, None), (1, 5, 2, ""), (1, 6, 2, None), (1, 7, None, None)]
    df = spark.createDataFrame(rows, "chapter_id int, unit_index int, turn_index int, speaker_name string")
    got = [r.effective_speaker for r in S.expand_turns(df).orderBy("unit_index").collect()]
    assert got == ["X", "X", "A", "B", None, "", None, None]


def test_correction(spark):
    rows = [(1, i, 0 if i < 3 else 1, True, "Alice" if i < 3 else "Bob") for i in range(4)]
    df = spark.createDataFrame(rows, "chapter_id int, unit_index int, turn_index int, dialogue_candidate boolean, effective_speaker string")
    at = lambda **c: sorted((r.unit_index, r.speaker_name) for r in S.correct(df, {"chapter_id": 1, **c}).collect())
    assert at(unit_index=0, end_index=1, scope="range", speaker="Alice") == [(0, "Alice"), (1, "Alice"), (2, "")]
    assert at(unit_index=1, scope="turn_tail", speaker=None) == [(1, ""), (2, "")]
    assert at(unit_index=1, scope="sentence", speaker="C") == [(1, "C")]


def test_consolidation(spark):
    rows = [(1, "Gorc", 4), (1, "Gorc Ivan", 7), (2, "Wolf", 2), (2, "Wolf Egon", 3), (2, "Wolf Fedor", 3)]
    got = {(r.g, r.name): r.target for r in S.consolidate(spark.createDataFrame(rows, "g int, name string, frequency int"), "g").collect()}
    assert got[1, "Gorc"] == "Gorc Ivan" and got[2, "Wolf"] == "Wolf"


def test_mentions_and_map(spark):
    df = spark.createDataFrame([(1, '"Come here," Anna said. Bob asked why. "What now?" Anna asked. The said.')], "k int, t string")
    assert [(r.name, r.frequency) for r in S.mentions(df, "k", "t").orderBy("name").collect()] == [("Anna", 4), ("Bob", 1)]
    pairs = S.dialogue_pairs(df, "k", "t")
    s = spark.createDataFrame([(1, 1, '"Come here," she said'), (1, 2, "no quote")], "k int, sentence_no int, sentence string")
    assert [r.speaker for r in S.find_speakers(s, pairs, "k").orderBy("sentence_no").collect()] == ["Anna", None]


def test_replies(spark):
    reply = '```json\n{"dialogues": ["0|Anna", "0|Bob", "1|narrator", "x|Y", "2|Carl|male"], "characters": []}\n```'
    df = spark.createDataFrame([(1, reply), (2, "no json"), (3, None)], "k int, r string")
    assert sorted((r.k, r.unit_id, r.speaker) for r in S.replies(df, "k", "r").collect()) == [(1, 0, "Anna"), (1, 2, "Carl")]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, R.insert_or_ignore(old, new, ["k"], [new["v"]]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert [r.k for r in R.stale_keys(old.withColumn("i", old["k"]), new.withColumn("i", new["k"]), ["k"], "i", ["v"]).orderBy("k").collect()] == [1, 2, 3]


def _clean(name):
    s = re.sub(r"\s+", " ", name or "").strip(" \t\r\n.,;:!?\"'„”").split("|")[0].strip()
    parts = [x.strip() for x in s.split(",")]
    if len(parts) == 2 and len(parts[0].split()) > 1 and 1 <= len(parts[1].split()) <= 3:
        s = parts[1]
    return "" if s.lower() in ("narrator", "unknown") else s[:120]


def test_assignments_of_all_names_against_brute_force(spark, tmp_path):
    names = ["", None, "Narrator", "Anna", "Zoë Hestow", "Dr. Hestow", "Hestow, Zoë", "Jean-Luc", "Ваня Рябинов", "翟家・景行", "अमित", "Anna|female", " Bob  Bram. ", "Ide figyelj, Jázmin", 'A "B" \\ C', "Unknown"]
    rows = [(k, 1 + k % 2, k // 4, n) for k, n in enumerate(names * 3)] + [(900, 1, None, "Anna"), (901, 3, 0, "Narrator"), (902, 3, 0, "Éva")]
    spark.createDataFrame(rows, "id long, chapter_id long, unit_index int, speaker_name string").write.parquet(f"{tmp_path}/speaker_annotations.parquet")
    want = {}
    for _, chapter, unit, name in sorted(rows, key=lambda r: r[0]):
        if unit is not None and _clean(name):
            want.setdefault((chapter, unit), _clean(name))
    got = entry.queries()["l8_assignments"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.chapter_id, r.unit_id): r.speaker for r in got} == want
    assert want[3, 0] == "Éva" and "Zoë Hestow" in want.values()
