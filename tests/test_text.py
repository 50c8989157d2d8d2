import hashlib

from pyspark.sql import functions as F

from quirelake.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0].x


def each(spark, fn, items):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "i int, s string")
    return [r.x for r in df.select("i", fn("s").alias("x")).orderBy("i").collect()]


def test_sections(spark):
    got = each(spark, T.is_explicit_section, ["Ch. 3", "Chapter Twenty-one", "II. fejezet", "Rész 2", "III", "VERDIER:", "B. L.", None, "", "ÉRSZEK"])
    assert got == [True, True, True, True, False, False, False, False, False, False]
    assert each(spark, T.section_type, ["Prologue", "2. rész", "Chapter 3", "The end", "Part II"]) == ["prologue", "part", "chapter", "chapter", "part"]
    assert each(spark, T.is_caps_heading, ["THE BEGINNING", "III", "B. L.", "VERDIER:", "Mixed", "12345", None]) == [True, False, False, False, False, False, False]


def test_language(spark):
    rows = ["Az ember nem volt itt, és még csak egy sem ő.", "The man was not here.", None, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    assert [r.lang for r in T.with_language(df, "s").orderBy("i").collect()] == ["hu", "en", "en", "en"]


def test_words_and_keys(spark):
    assert each(spark, T.word_count, ["a b\xa0c\td", "", None, "  x "]) == [4, 0, 0, 1]
    assert each(spark, T.title_key, ["The  End!", None, "Élet"]) == ["the end", "", "let"]
    assert each(spark, T.normalise, ["a\r\nb\xa0c​d﻿\x07e", None]) == ["a\nb cd e", ""]


def tags(spark, rows):
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "i int, s string, d boolean")
    return [r.tag for r in T.with_tag(df, "s", F.col("d")).orderBy("i").collect()]


def test_tags(spark):
    assert tags(spark, [('"What?!"', True), ('"Fine," he laughed.', True), ("He laughed.", False), ('"Well," she sighed.', True), ('"No," he nodded.', True), (None, True)]) == [None, "[laughter]", None, "[sigh]", None, None]


def test_tag_placement(spark):
    df = spark.createDataFrame([('He said "hello there" to me.', "[sigh]"), ("Plain.", "[sigh]"), ("Plain.", None)], "s string, t string")
    assert [r.x for r in df.select(T.inject_tag("s", "t").alias("x")).collect()] == ['He said "[sigh] hello there" to me.', "[sigh] Plain.", "Plain."]


def test_pauses(spark):
    rows = [("Well...", 0, 0, 0), ("“Well…”", 1, 1, 1), ("End.", 1, 0, 0), ("A.", 0, 1, 1), ("A.", 0, 1, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, e int, d int, n int")
    assert [r.x for r in df.orderBy("i").select(T.pause_after("s", "e", "d", "n").alias("x")).collect()] == [1.5, 1.5, 0.85, 0.55, 0.35, 0.35]


def test_times_and_colours(spark):
    assert one(spark, T.srt_time(F.lit(3661.25))) == "01:01:01,250"
    assert one(spark, T.srt_time(F.lit(2.3))) == "00:00:02,299"
    assert each(spark, T.ass_colour, ["#12ab34"]) == ["34AB12"]
    for name in ("Anna", "Győző", "X"):
        n = int(hashlib.md5(name.lower().encode()).hexdigest(), 16) % 15
        assert each(spark, T.voice_colour, [name]) == [T.P.COLOURS[n]]


def test_cache_key(spark):
    none = F.lit(None).cast("string")
    got = one(spark, T.cache_key(F.lit("Hi"), none, none, none, F.lit(1.0), none))
    assert got == hashlib.md5(b"Hi|None|None|None|1.00||nt=0|ns=16|audio-cache-v=2").hexdigest()


def test_instruct(spark):
    assert each(spark, T.stable_instruct, ["male, child, british accent", "female, teenager, low pitch", "male, adult", "", None]) == ["male, high pitch, british accent", "female, teenager, moderate pitch", "male, adult", None, None]


def test_selection(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["5, 1, 3-4, 3", "all", "0", "1,,2", "4-2", "1,a", "7", None])], "i int, s string")
    got = [r.x for r in df.select("i", T.number_range("s", F.lit(6)).alias("x")).orderBy("i").collect()]
    assert got == [[1, 3, 4, 5], [1, 2, 3, 4, 5, 6], None, None, None, None, None, [1, 2, 3, 4, 5, 6]]


def test_names(spark):
    assert each(spark, T.clean_speaker, [" Anna. ", "Anna|female", "Ide figyelj, Jázmin", "Narrator", None, "Smith, John"]) == ["Anna", "Anna", "Jázmin", "", "", "Smith, John"]
    assert each(spark, T.safe_name, ["A b/c!", "", None]) == ["A_bc", "export", "export"]


def test_glyphs_and_tokens(spark):
    df = spark.createDataFrame([("õû", "hu"), ("õû", "pt")], "s string, l string")
    assert [r.x for r in df.select(T.repair_glyphs("s", "l").alias("x")).collect()] == ["őű", "õû"]
    assert each(spark, T.control_tokens, ["[laughter] a [odd] b"]) == ["<|sfx:laughter|>Haha a  b"]


def test_eta(spark):
    df = spark.createDataFrame([(5, 10, 10.0, 4, 2.0), (5, 10, 2.0, 0, 0.5), (10, 10, 9.0, 9, 9.0), (5, 10, 10.0, None, None)], "d int, t int, e double, sd int, se double")
    assert [r.x for r in df.select(T.eta_seconds("d", "t", "e", "sd", "se").alias("x")).collect()] == [2.5, None, None, 10.0]


def test_small_arithmetic(spark):
    import math

    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    secs = [None, -1.0, float("nan"), 0.5, 1.5, 45.2, 59.5, 60.0, 185.0, 3599.6, 7630.0]
    made = [one(T.eta_text(F.lit(x).cast("double"))) for x in secs]

    def want(v):
        if v is None or v < 0 or math.isnan(v):
            return ""
        v = int(round(v))
        return f"{v}s" if v < 60 else f"{v // 60}m {v % 60:02d}s" if v < 3600 else f"{v // 3600}h {v // 60 % 60:02d}m"

    assert made == [want(x) for x in secs]
    assert [one(T.clamped_index(F.lit(x), F.lit(5))) for x in ("3", " 9px", "-2", "x", None, "99999999999999999999")] == [3, 4, 0, 0, 0, 4]
    assert one(T.clamped(F.lit("x"), 1, 9, 4)) == 4.0 and one(T.clamped(F.lit("12"), 1, 9, 4)) == 9.0 and one(T.nearest(F.lit("20"), (8, 16, 24, 32), 16)) == 16
    assert one(T.endpoint(F.lit(" http://h/v1/ "), "models")) == "http://h/v1/models" and one(T.endpoint(F.lit("/"), "models")) is None
    assert one(T.studio_voice(F.lit("x, MALE, female, elderly, child"))) == "male, child, moderate pitch, american accent"
    assert one(T.section_type(F.lit("Part Twentyone"))) == "part" and one(T.section_type(F.lit("Party"))) == "chapter"


def test_numbers_and_brackets():
    assert [T.spelled(n) for n in (0, 13, 21, 80, 100, 101, 342, 1000, 1001, 12345, 1000000, 2000100)] == [
        "zero", "thirteen", "twenty-one", "eighty", "one hundred", "one hundred and one", "three hundred and forty-two", "one thousand", "one thousand and one",
        "twelve thousand, three hundred and forty-five", "one million", "two million, one hundred",
    ]
    assert T.outside_brackets("a [b 1] c [d", str.upper) == "A [b 1] C [D" and T.outside_brackets("", str.upper) == ""
    assert T.spelled(10**30) == str(10**30)


def test_numbers_in_words(spark):
    rows = [(1, "He had 21 [tag 3] cats.", "en"), (2, "21", "hu"), (3, None, "en"), (4, "none", None)]
    got = spark.createDataFrame(rows, "i int, t string, l string").select("i", T.numbers_spelled("t", "l").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["He had twenty-one [tag 3] cats.", "21", None, "none"]


def test_framed_replies_and_loudness():
    assert T.first_object('x REPLY_JSON: {"a": {"b": 1}} tail {') == '{"a":{"b":1}}'
    assert T.first_object("REPLY_JSON: [1]") is None and T.first_object("REPLY_JSON: {") is None and T.first_object(None) is None


def test_assent_needs_all_of_the_quotation(spark):
    rows = [(1, "“Yes,” she agreed."), (2, "“Yes.”"), (3, "“Nod”"), (4, "Indeed nodded.")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "“yes” - agreed"), (2, "“Agreed, and more of it then”"), (3, "“Yes, of course,” nodded Ben.")], "i int, t string")
    assert rows and [r.tag for r in T.with_tag(df, "t", F.lit(True)).orderBy("i").collect()] == [None, None, None]


def test_samples(spark):
    import random

    rng = random.Random(1)
    rows = []
    for k in range(60):
        texts = ["x" * rng.randint(0, 9) for _ in range(rng.randint(1, 7))]
        rows.append((k, rng.randint(len(texts), 90), texts, [rng.uniform(-1, 1) for _ in range(rng.randint(0, 9))]))

    def parts(n, texts):
        w, out, at = [max(1, len(t)) for t in texts], [], 0
        for i, x in enumerate(w):
            left = len(w) - i - 1
            take = n - at if not left else max(1, min(int(round(n * (x / float(sum(w))))), n - at - left))
            out.append(take)
            at += take
        return out

    df = spark.createDataFrame(rows, "k int, n int, texts array<string>, a array<double>")
    for r in df.select("k", T.split_lengths("n", "texts").alias("p"), T.zero_crossings("a").alias("z"), T.expanded_reference("a", 2).alias("e")).collect():
        _, n, texts, a = rows[r.k]
        assert r.p == parts(n, texts)
        signs = [x < 0 for x in a]
        assert abs(r.z - (sum(x != y for x, y in zip(signs, signs[1:])) / (len(a) - 1) if len(a) > 1 else 0)) < 1e-9
        assert r.e == (a * -(-8 // len(a)) if 0 < len(a) < 4 else a)


def test_composed(spark):
    df = spark.createDataFrame([("e\u0301\xa0ﬁ\u200b\r\n\x07",), (None,), ("plain",)], "t string")
    assert [r.x for r in df.select(T.normalise("t").alias("x")).collect()] == ["é fi\n ", "", "plain"]
