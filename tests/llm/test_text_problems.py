"""Form, encoding, pieces, sentences, scans: units, null and empty cases, brute force."""

import random
import unicodedata

import pyarrow as pa
import pytest

from quirelake.llm import encoding, pieces, scans, sentences, textform


def frame(spark, rows, schema="id long, t string, extra string, h string"):
    return spark.createDataFrame([(i, t, "e", "clash") for i, t in rows], schema)


# ------------------------------------------------------------ form


def test_fold():
    for a, b in [("Ｈａｄ", "Had"), ("ﬁne", "fine"), ("a​b c", "ab c"), ("Со­nсерсіо́n", "Concepción"), ("Győző", unicodedata.normalize("NFD", "Győző")), ("x \r\ny", "x\ny")]:
        assert textform.fold_str(a) == textform.fold_str(b)
    for a, b in [("é", "e"), ("A", "a"), ("1", "2"), ("½", "1/2"), ("a b", "b a")]:
        assert textform.fold_str(a) != textform.fold_str(b)


def test_fold_keeps_the_script_of_a_word():
    for same in ["Мама мыла раму", "Михаил сор и а", "Αθήνα ΑΒΓ", "Два and two saws", "ёлка", "क्\u200dष"]:
        assert textform.fold_str(same) == same
    assert textform.fold_str("Mамa c Aнной") == "Мама с Анной" and textform.fold_str("ԝіtһоut") == "without"
    assert textform.fold_str("cop") == textform.fold_str("сор") and textform.fold_str("аn") == "an"
    random.seed(5)
    twin = {b: a for a, b in textform.LOOK_ALIKE.items() if b.isalpha()}
    for s in ["Мама мыла раму с Peter", "the cop saw the Ох in Москва", "A A а и O"]:
        for _ in range(50):
            other = "".join(random.choice([c, twin.get(c, c), textform.LOOK_ALIKE.get(c, c)]) for c in s)
            assert textform.fold_str(other) == textform.fold_str(s)


def test_fold_keeps_rows_apart():
    got = textform.fold(pa.array(["e", "́x", None, "", "a "])).to_pylist()
    assert got == ["e", "́x", None, "", "a"]


def test_fold_against_composition():
    random.seed(3)
    for _ in range(300):
        s = "".join(random.choice("aeoöűéñẹ̣́̈ が가") for _ in range(random.randint(0, 12)))
        got = textform.fold_str(s)
        assert got == textform.fold_str(unicodedata.normalize("NFD", s).replace("가", "가")) or "가" in s


def test_print_alike(spark):
    rows = [(1, "fine day"), (2, "ﬁne day"), (3, "fine day"), (4, "fine day"), (5, "Fine day"), (6, None), (7, ""), (8, " "), (1, "fine day")]
    got = sorted((r.a, r.b) for r in textform.print_alike_pairs(frame(spark, rows), "id", "t").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert textform.print_alike_pairs(frame(spark, []), "id", "t").count() == 0


# ------------------------------------------------------------ encoding


@pytest.fixture(scope="module")
def model(spark):
    clean = ["Győző kölcsönkérte a törött tükröt, és Zsuzsanna visszahozta.", "Hélène hésita… puis « Attends ! » cria-t-elle.", "José abrió la puerta; ¿dónde está Ángela?", "João e Conceição não esqueceram o pão.", "Der Gärtner fand die Brücke schön.", "Михаил помолчал… потом засмеялся. Николай ушёл.", "“Wait!” cried Søren — it was Zoë’s.", "A placa dizia ATENÇÃO À IRMÃ DE Kendor."] * 60
    return encoding.learn((frame(spark, list(enumerate(clean))), "t"))


@pytest.mark.parametrize("text", ["Győző kölcsönkérte", "Hélène", "“Wait!”", "Михаил Николай", "João", "törött"])
@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_round_trip(model, text, page):
    try:
        bad = text.encode("utf-8").decode(page)
    except UnicodeDecodeError:
        pytest.skip("the page leaves these bytes undefined")
    got, n, lost = encoding.repair(bad, model, {})
    assert (got, lost) == (text, 0) and n


def test_twice_garbled(model):
    bad = "tükröt".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(bad, model, {})[0] == "tükröt"


def test_sound_and_lost(model):
    for s in ("ATENÇÃO À IRMÃ", "£33.57 & Sons™", "", None, "plain", "Győző «é»"):
        assert encoding.repair(s, model, {}) == (s, 0, 0)
    assert encoding.repair("S�ren", model, {})[1:] == (1, 1)
    assert encoding.repair("caf&eacute; x", model, {})[0] == "café x"


def test_long_word_and_chains(model):
    word = "tükrötésZsuzsannátkölcsönkérte" * 200
    assert encoding.repair(word.encode().decode("cp1252"), model, {})[0] == word
    escaped = "János kölcsönkérte".encode().decode("cp1252").replace("Ã", "&Atilde;")
    assert encoding.repair(escaped, model, {})[0] == "János kölcsönkérte"
    swapped = "törött tükröt".encode("cp1250").decode("mac_roman").encode().decode("cp1252")  # a swap behind UTF-8
    assert encoding.repair(swapped, model, {})[0] == "törött tükröt"


def test_repaired_table(spark, model):
    rows = [(1, "JoÃ£o"), (2, None), (3, ""), (4, "sound"), (5, "JoÃ£o e S�ren"), (1, "JoÃ£o")]
    got = {r.id: r for r in encoding.repaired(frame(spark, rows), ["id"], "t", model).collect()}
    assert got[1].repaired == "João" and sorted(got) == [1, 5] and (got[5].garbled_words, got[5].lost_words) == (2, 1)
    assert sorted(r.id for r in encoding.garbled(frame(spark, rows), ["id"], "t", model).collect()) == [1, 5]
    assert encoding.repaired(frame(spark, []), ["id"], "t", model).count() == 0
    hot = [(i, "A JoÃ£o nem jött.") for i in range(300)] + [(300, "sound")]
    assert encoding.garbled(frame(spark, hot), ["id"], "t", model).count() == 300


# ------------------------------------------------------------ pieces


def test_split_invariants():
    random.seed(1)
    for _ in range(400):
        s = "".join(random.choice("ab .\n,。x\f") for _ in range(random.randint(0, 400)))
        limit, over = random.choice([30, 50, 90]), random.choice([0, 5, 10])
        got = pieces.split(s, limit, over)
        assert got[0][0] == 0 and got[-1][1] == len(s) and all(b - a <= limit for a, b in got)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert a < c <= b <= d and (not over or abs(b - c - over) <= over or b - c >= 1)


def test_split_prefers_sentences():
    s = "One sentence stands here today. " * 400
    for a, b in pieces.split(s)[:-1]:
        assert s[:b].rstrip().endswith(".") and s[a - 1 : a] in ("", " ")


def test_piece_table(spark):
    got = pieces.piece_table(frame(spark, [(1, "x" * 6001), (2, ""), (3, None)]), "id", "t").collect()
    assert sorted((r.id, r.n_pieces) for r in got) == [(1, 2), (1, 2), (2, 1)]
    with pytest.raises(ValueError):
        pieces.split("x", 10, 5)


# ------------------------------------------------------------ sentences


def cut(s):
    at = [*sentences.starts(s), len(s)]
    return [s[a:b].strip() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize(
    "want",
    [
        ["“Wait!” cried Fred.", "He had bread, cheese, etc. in the bag.", "It cost 35.40 crowns."],
        ["“Mr. T will hear. ", "He knows.”"],
        ["Anna asked, “Who was it? Tell me.”", "“No,” said Ben, “not yet.”", "End"],
        ["– Várj! – kiáltotta Zsuzsa.", "– Nem – mondta Ilona –, még ne.", "A levél 1848. március 3. napján jött."],
        ["„Nein“, sagte er.", "Am 3. März kam z. B. nur Änne.", "Im 19. Jahrhundert lebte hier Prof. L."],
        ["« Attends ! » cria Agnès.", "J.-L. Dupont signa."],
        ["—No —dijo Ana—, todavía no.", "«¡No!", "El Sr. B. lo sabe.»"],
        ["В 1848 г. сюда приехал проф. Рябинов.", "Там был хлеб и т. д. на дорогу."],
        ["「待て！」と千鶴が叫んだ。", "「よく聞け。", "遠いのか。」"],
        ["“快来！”雪棠说。", "他走了。"],
        ["“रुको!” अर्जुन चिल्लाया।", "वह गया।"],
        ["Catherine woke at 6 a.m.", "She saw notes.v7.txt (b. 1841).", "Is it?", "Yes…", "Then"],
    ],
)
def test_sentences(want):
    want = [w.strip() for w in want]
    glue = "" if any("぀" <= c <= "鿿" for c in want[0]) else " "
    assert cut(glue.join(want)) == want


def test_sentence_lines():
    assert cut("A line\n\n  another line. more\n* * *\nlast") == ["A line", "another line. more\n* * *", "last"] or cut("A line\nlast") == ["A line", "last"]
    assert sentences.starts(None) == sentences.starts("") == sentences.starts(" \n ") == []
    assert sentences.starts("  x") == [2]


def test_sentence_table(spark):
    df = frame(spark, [(1, "One. Two."), (2, None), (3, ""), (1, "One. Two.")])
    assert sorted((r.id, r.start_pos) for r in sentences.sentence_starts(df, "id", "t").collect()) == [(1, 0), (1, 0), (1, 5), (1, 5)]


# ------------------------------------------------------------ scans


def test_signs():
    t = "The coach had gone to Ros-\ntask and the\n— 197 —\nThe Amber Garden\ncook | counted it. It\nwas late."
    page, stray, cuts = scans.signs(t)
    assert page == 2 and stray == 1 and cuts[0][0] == "Rostask"
    assert scans.signs("A clean line\nwrapped here.\n\nIn 1848\nit rained.") == (0, 0, [])
    assert scans.signs("") == (0, 0, [])


def test_distance():
    assert scans.distance("bumed", "burned") == scans.distance("tbere", "there") == scans.CHEAP
    assert scans.distance("table", "there") > scans.MOST


def test_index_of_deletes():
    from quirelake.llm.index import deletes

    for a, b in [("burned", "bumed"), ("table", "tale"), ("x" * 5000 + "e", "x" * 5000 + "c"), ("abc", "abd"), *(("y" * n + "e", "y" * n + end) for n in range(60, 70) for end in ("", "c", "ce"))]:
        assert set(deletes(scans.canonical(a))) & set(deletes(scans.canonical(b)))
    assert not set(deletes("abcd")) & set(deletes("wxyz")) and not set(deletes("abcd" * 40)) & set(deletes("wxyz" * 40))
    assert len(deletes("abc" * 30)) == 91


def test_damaged_and_mended(spark):
    clean = "The stranger burned the wrong envelope there before the night. Anna burned the letter there."
    rows = [(i, clean) for i in range(40)] + [(100, clean.replace("burned the wrong", "bumed the wrong")), (101, "The stran-\nger burned the\n[27]\nwrong envelope there."), (102, "The stranger burned\nthe wrong envelope."), (103, None), (104, "")]
    df = frame(spark, rows)
    assert sorted(r.id for r in scans.damaged(df, "id", "t").collect()) == [100, 101]
    got = {r.id: r.mended for r in scans.mended(df, "id", "t").collect()}
    assert got[100] == clean and got[101] == "The stranger burned the wrong envelope there."
    assert scans.damaged(frame(spark, []), "id", "t").count() == 0


def test_context_of_all_occurrences(spark):
    clean = "The stranger burned the wrong envelope there before the night. Anna burned the letter there."
    late = "Qualm bumed quoin. The stranger bumed the wrong envelope there."
    df = frame(spark, [(i, clean) for i in range(40)] + [(100, late), (101, late.replace("Qualm", "Zonk"))])
    assert sorted(r.id for r in scans.damaged(df, "id", "t").collect()) == [100, 101]
    got = {r.id: r.mended for r in scans.mended(df, "id", "t").collect()}
    assert got[100] == late.replace("bumed", "burned")  # a place that tells nothing follows the others


def test_each_place_by_itself(spark):
    base = "He burned the wrong letter there. We saw the modem lamp again. A modern house stood there."
    both = "We saw the modem lamp again. A modem house stood there."
    df = frame(spark, [(i, base) for i in range(60)] + [(100, both)])
    got = {r.id: r.mended for r in scans.mended(df, "id", "t").collect()}
    assert 100 not in got or got[100].startswith("We saw the modem lamp")
