import io
import zipfile

import pytest

from quirelake.operators import schedule as C
from quirelake.sources import plain as L


def test_packs(spark):
    rows = [(1, i, 10) for i in range(10)] + [(2, 0, 500)]
    df = spark.createDataFrame(rows, "g int, i int, n int")
    got = C.packs(df, ["g"], ["i"], "n", 4, 1000).groupBy("g", "pack_no").count().orderBy("g", "pack_no").collect()
    assert [r["count"] for r in got] == [4, 4, 2, 1]


def test_lanes_are_balanced(spark):
    df = spark.createDataFrame([(1, i, 40 + 17 * (i % 5)) for i in range(20)], "g int, i int, n int")
    cost = {r.lane: r.s for r in C.lanes(df, "g", "i", "n").selectExpr("lane", "n*n as c").groupBy("lane").agg({"c": "sum"}).withColumnRenamed("sum(c)", "s").collect()}
    assert max(cost.values()) / min(cost.values()) < 1.35


def test_timeline_and_subtitles(spark):
    rows = [(1, 0, "a", 0, 1, 1.0, "A"), (1, 1, "b...", 0, 1, 2.0, None), (1, 2, "c", 1, 0, 3.0, "A")]
    df = spark.createDataFrame(rows, "book_id int, i int, text string, ends_paragraph int, is_dialogue int, duration_sec double, character_name string")
    t = C.timeline(df, ["book_id"], "i")
    assert [round(r.t_start, 6) for r in t.orderBy("i").collect()] == [0.0, 1.55, 5.05]
    assert C.srt(t, ["book_id"], "i").collect()[0].body.startswith("1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n")
    body = C.ass(t, spark.createDataFrame([(1, "A", "#010203")], "book_id int, name string, color_hex string"), ["book_id"], "i", "T").collect()[0].body
    assert "Style: A,Arial,28,&H00030201" in body and "Dialogue: 0,0:00:00.00,0:00:01.00,A,A,0000,0000,0000,,{\\i1}a{\\i0}" in body


def test_durations(spark):
    assert C.synthesize(spark.createDataFrame([("a b", 2.0), (None, None)], "t string, s double"), "t", "s").count() == 2


def test_html():
    assert L.html_lines("<p>a&nbsp;b<script>x</script><br>c</p><div> d </div>") == ["a b", "c", "d"]
    assert L.html_lines(None) == []


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="{n}.html" media-type="application/xhtml+xml"/>' for n in range(3))
        refs = "".join(f'<itemref idref="i{n}"/>' for n in range(3))
        z.writestr("o/c.opf", f'<package><metadata><title>T</title><creator>A</creator><language>hu-HU</language></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for n, t in enumerate(["Chapter 1</p><p>" + "w " * 60, "tail words", "Acknowledgements"]):
            z.writestr(f"o/{n}.html", f"<html><p>{t}</p></html>")
    return out.getvalue()


def test_books(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes("Title\nChapter 1\n".encode() + b"caf\xe9 " * 40)
    rows = {r.path[-6:]: r for r in L.web_books(spark, str(tmp_path)).collect()}
    assert [c.title for c in rows["a.epub"].chapters] == ["Chapter 1"] and "tail words" in rows["a.epub"].chapters[0].content
    assert rows["a.epub"].language == "hu" and rows["b.epub"].chapters == []
    assert L.chapter_rows(L.plain_books(spark, str(tmp_path))).collect()[0].section_type == "chapter"
    with pytest.raises(ValueError):
        L.read_books(spark, str(tmp_path), "pdf")


def test_layout(spark):
    spans = "array<struct<text:string,bbox:array<double>,size:double>>"
    s = [("gy", [0.0, 0.0, 10.0, 9.0], 12.0), ("ő", [10.0, 0.0, 15.0, 9.0], 12.0), ("z", [15.0, 0.0, 20.0, 9.0], 12.0), ("első", [24.0, 0.0, 40.0, 9.0], 12.0)]
    got = spark.createDataFrame([(s,), ([],), (None,)], f"s {spans}").select(L.join_spans("s").alias("x")).collect()
    assert [r.x for r in got] == ["győz első", "", None]
    rows = [(1, 0, "42", [290.0, 0.0, 310.0, 9.0], 600.0, 12.0), (1, 1, "42", [50.0, 0.0, 70.0, 9.0], 600.0, 12.0), (1, 2, "Chapter A", None, None, 18.0), (1, 3, "x " * 80, None, None, 12.0)]
    df = spark.createDataFrame(rows, "k int, pos int, text string, bbox array<double>, page_width double, size double")
    kept = L.without_page_numbers(df)
    assert [r.pos for r in kept.orderBy("pos").collect()] == [1, 2, 3]
    assert [(r.order_num, r.title) for r in L.layout_chapters(kept, "k", "D").collect()] == [(0, "Chapter A")]


def test_settings():
    assert L.merged_settings('{"a": 2}', {"a": 1, "b": 3}) == {"a": 2, "b": 3} and L.merged_settings("[", {"a": 1}) == {"a": 1}
