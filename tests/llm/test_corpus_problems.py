"""Language, names, leaks, mixing, subjects: fixtures, brute force, held-out accuracy, null and empty cases."""

import random

import numpy as np
import pytest

from quirelake.llm import encoding, language, leaks, mixing, names, subjects

# ------------------------------------------------------------ language

SAY = {
    "en": "The old man walked to the {} and said nothing about it. She had never seen the harbour before dawn. ",
    "de": "Der alte Mann ging langsam zum {} und sagte nichts dazu. Sie hatte den Hafen noch nie gesehen. ",
    "fr": "Le vieil homme marchait vers le {} et ne dit rien. Elle n’avait jamais vu le port avant l’aube. ",
    "es": "El viejo caminaba hacia el {} y no dijo nada. Ella nunca había visto el puerto antes del alba. ",
    "pt": "O velho caminhava para o {} e não disse nada. Ela nunca tinha visto o porto antes da manhã. ",
    "hu": "Az öreg ember lassan ment a {} felé, és nem szólt semmit. Soha nem látta még a kikötőt hajnal előtt. ",
    "ru": "Старик медленно шёл к {} и ничего не сказал. Она никогда не видела гавань до рассвета. ",
}


@pytest.fixture(scope="module")
def disc():
    rows = [(SAY[x].format(f"Lum{i}"), x) for x in SAY for i in range(30)]
    rows[3] = (rows[3][0], "hu")  # a wrong label
    return language.fit(rows)


def test_passages(disc):
    for x in SAY:
        assert [p[2] for p in language.passages([SAY[x].format("Brook") * 3], disc)[0]] == [x]
    mixed = SAY["en"].format("a") * 4 + "\n\n" + SAY["ru"].format("b") * 2 + "\n\n" + SAY["en"].format("c") * 3
    got = language.passages([None, mixed, "x"], disc)[1]
    assert [p[2] for p in got] == ["en", "ru", "en"] and got[1][4] == 4 and got[0][3] > 0.8
    assert language.passages([None, "", "  \n"], disc) == [[], [], []]


def test_labels(spark):
    rows = [(x,) for x in ("en", " EN ", "en-GB", "English", "magyar", "hun", "zh-CN", "und", "", None, "n/a", "--", "unknown", "Italian", "pt_BR")]
    got = [r.x for r in spark.createDataFrame(rows, "l string").select(language.label_expr("l").alias("x")).collect()]
    assert got == ["en", "en", "en", "en", "hu", "hu", "zh", None, None, None, None, None, None, "other", "pt"]


def test_passage_table(spark, disc):
    df = spark.createDataFrame([(1, 7, SAY["hu"].format("x")), (2, 7, None), (3, 7, "")], "id long, book_id long, t string")
    assert [(r.id, r.book_id, r.lang) for r in language.passage_table(df, "id", "t", disc, "book_id").collect()] == [(1, 7, "hu")]


# ------------------------------------------------------------ names


@pytest.mark.parametrize("a,b", [("Zoë Hestow", "ZOË HESTOW"), ("Hestow, Zoë", "Zoë Hestow"), ("Zoë P. Hestow", "Zoë Hestow"), ("Dr. Zoë Hestow", "Zoe_Hestow"), ("Bob Norringham", "Robert Norringham"), ("Kät. Hölz", "Käthe Hölz"), ("Benediict Wynburn", "Benedict Wynburn"), ("X & Y Shipping Company", "The X and Y Shipping Co."), ("güntherrüstlich", "Günther Rüstlich"), ("翟家景行先生", "翟家・景行"), ("Ваня Рябинов", "ИВАН РЯБИНОВ")])
def test_same(a, b):
    assert names.same(a, b) and names.same(b, a)


def test_assignment_of_long_names():
    x = "Maria Anna Sofia Elena Clara Julia Lornestow"
    y = "Anna Maria Sofia Elena Clara Julia Lornestow"
    assert names.same(x, y) and names.same(x, "Lornestow, Julia Clara Elena Sofia Anna Maria")
    assert not names.same(x, "Maria Anna Sofia Elena Clara Julia Quarrdale")
    from itertools import permutations

    rng = random.Random(3)
    pool = ["anna", "anne", "a.", "ben", "benny", "benjamin", "corrock", "corock", "co.", "dale"]
    for _ in range(150):
        a, b = (names.parse(" ".join(rng.sample(pool, rng.randint(1, 4))))[0] for _ in range(2))
        a, b = sorted((a, b), key=len)
        left = [0.1 if t[1] and len(t[0]) == 1 or t[0] in names.FORMS else 9.0 for t in b]
        want = min(sum(names.token_cost(x, b[j]) for x, j in zip(a, o)) + sum(left[j] for j in range(len(b)) if j not in o) for o in permutations(range(len(b)), len(a)))
        got = names.assign(a, b)[0]
        assert abs(got - want) < 1e-6 or got >= 9 and want >= 9


def test_classes(spark):
    long = "wrothmuirbrackendaleskerryholmfirthtarn" * 3
    rows = [(1, "Gandalfo"), (1, "Gandalfo."), (1, "Gandalpho"), (1, "Gandalfa"), (2, "Gandalfo"), (2, "Gandlfo"), (2, "Anna"), (2, "Anne"), (3, "Zoë " + long), (3, "Zoë " + long[:60] + long[61:]), (3, None), (3, "Narrator"), (None, "x")]
    got = {(r.g, r.n): (r.class_id, r.spellings) for r in names.variant_classes(spark.createDataFrame(rows, "g long, n string"), "g", "n").collect()}
    same = lambda g, a, b: got[g, a][0] == got[g, b][0]
    assert same(2, "Gandalfo", "Gandlfo") and not same(2, "Anna", "Anne") and same(1, "Gandalfo", "Gandalfo.")
    assert same(1, "Gandalfo", "Gandalfa")
    assert same(3, "Zoë " + long, "Zoë " + long[:60] + long[61:]) and got[2, "Gandalfo"][1] == 2 and len(got) == 10
    more = [(1, "Gandalfo"), (1, "Gandalfa"), (1, "Gandalfi")]  # each has two near ones
    n = {r.class_id for r in names.variant_classes(spark.createDataFrame(more, "g long, n string"), "g", "n").collect()}
    assert len(n) == 3
    assert names.variant_classes(spark.createDataFrame([], "g long, n string"), "g", "n").count() == 0


@pytest.mark.parametrize("a,b", [("Anna Corrock", "Anna Corrimer"), ("Ben Ellburn", "Winifred Ellburn"), ("Zoë P. Hestow", "Zoë R. Hestow"), ("卓氏之若溪", "晏氏之若溪")])
def test_not_same(a, b):
    assert not names.same(a, b)


def test_variants(spark):
    rows = [(1, x) for x in ("Zoë Hestow", "Hestow", "Zoë P. Hestow", "Ann Bram", "Rob Bram", "Bram", "", "Narrator", "Unknown", None, "Zoë Hestow")] + [(2, "Hestow"), (None, "Hestow")]
    df = spark.createDataFrame(rows, "book_id long, name string")
    got = sorted((r.book_id, r.name_a, r.name_b) for r in names.variant_pairs(df, "book_id", "name").collect())
    assert got == [(1, "Hestow", "Zoë Hestow"), (1, "Hestow", "Zoë P. Hestow"), (1, "Zoë Hestow", "Zoë P. Hestow")]
    assert names.variant_pairs(df.where("false"), "book_id", "name").count() == 0


def test_one_edit_against_brute_force():
    random.seed(2)

    def neighbours(s):
        out = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1)}
        return out | {s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in "abc"} | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in "abc"}

    for _ in range(500):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(2))
        assert names.one_edit(a, b) == (b in neighbours(a)), (a, b)


# ------------------------------------------------------------ leaks


def test_tile_against_brute_force():
    random.seed(4)
    for _ in range(200):
        d, i = ([random.choice("abcd") for _ in range(random.randint(0, 40))] for _ in range(2))
        best = max((n for x in range(len(d)) for y in range(len(i)) for n in range(1, 41) if d[x : x + n] == i[y : y + n] and len(d[x : x + n]) == n), default=0)
        got = leaks.tile(d, i, 3)
        assert max((t[2] for t in got), default=0) == (best if best >= 3 else 0)
        assert all(d[a : a + n] == i[b : b + n] for a, b, n in got)
        assert len({k for a, _, n in got for k in range(a, a + n)}) == sum(t[2] for t in got)


def test_leaks(spark):
    item = " ".join(f"w{k}" for k in range(30))
    a, b = " ".join(f"w{k}" for k in range(10)), " ".join(f"W{k}," for k in range(15, 27))
    docs = [(1, f"x y {item.upper()} z"), (2, f"{b} – foo {a}"), (3, f"{a} no"), (4, None), (5, ""), (6, " ".join(f"w{k}" for k in range(5, 17))), (1, f"x y {item} z")]
    d = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    exact = leaks.leaked(d, i, seed=12, min_run=12, min_coverage=2.0)
    assert sorted((r.doc_id, r.item_id) for r in exact.collect()) == [(1, 9), (1, 9), (2, 9), (6, 9)]
    again = leaks.leaked(d, i, seed=12, min_run=12, min_coverage=2.0, block_words=1)
    assert sorted((r.doc_id, r.item_id) for r in again.collect()) == [(1, 9), (1, 9), (2, 9), (6, 9)]
    cover = {r.doc_id: r.coverage for r in leaks.leaked(d, i).collect()}
    assert cover[2] == pytest.approx(22 / 30)
    assert leaks.leaked(d, i.where("false")).count() == 0


def test_short_reordered_passages(spark):
    ws = [f"w{k}" for k in range(30)]
    docs = [(1, " foo ".join(" ".join(ws[a : a + 6]) for a in (24, 12, 0, 18, 6))), (2, " foo ".join(" ".join(ws[a : a + 4]) for a in (24, 12, 0, 18, 6)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(ws))], "item_id long, text string")
    assert [(r.doc_id, r.coverage, r.tiles) for r in leaks.leaked(d, i).collect()] == [(1, 1.0, 5)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for k in range(30)]
    docs = [(k, " ".join(w for _ in range(6) for x in [rng.choice(items)[1].split()] for a in [rng.randint(0, 30)] for w in [*x[a : a + rng.randint(4, 9)], "z"])) for k in range(60)]
    want = set()
    for dk, t in docs:
        for ik, u in items:
            tiles = leaks.tile(t.split(), u.split(), 5)
            if tiles and (max(x[2] for x in tiles) >= 12 or sum(x[2] for x in tiles) >= 0.5 * len(u.split())):
                want.add((dk, ik, sum(x[2] for x in tiles)))
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.covered) for r in got.collect()} == want and len(want) > 10


# ------------------------------------------------------------ mixing


def test_schedules():
    w = mixing.schedules({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4})
    assert np.allclose(sum(w.values()), 1, atol=1e-6)
    assert [round(mixing.demand(w[s])[-1], 4) for s in "abc"] == [0.5, 0.3, 0.2]
    assert w["a"][0] > w["a"][-1] and w["c"][0] < w["c"][-1]


def test_mixture(spark):
    rows = [(i, "some words of text here", "big") for i in range(400)] + [(1000 + i, "some words of text here", "small") for i in range(20)] + [(2000, None, "big"), (2001, " ", "small"), (2002, "x", None), (2003, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 3), ("gone", 0.2, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mixture(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    assert got["big"].share == pytest.approx(0.75, abs=0.01) and got["small"].share == pytest.approx(0.25, abs=0.01) and got["gone"].share == 0
    assert got["small"].most_uses == 3 and got["small"].uses == 60
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    empty, plan = mixing.mixture(docs.where("false"), targets)
    assert empty.count() == 0 and mixing.shares(empty, plan).count() == 3


# ------------------------------------------------------------ subjects

TERMS = {"law": "judge court appeal statute jury bail".split(), "sport": "goal match team sprint referee medal".split(), "music": "chord melody tempo choir oboe score".split()}


def sentence(rng, s):
    a, b = rng.sample(TERMS[s], 2)
    return rng.choice([f"Nothing about the {a} surprised Anna, who knew the {b}.", f"The {a} depends on the {b} in Lum{rng.randint(1, 99)}.", f"It took {rng.randint(2, 90)} hours to explain the {a} and the {b}."])


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(5)
    docs, labels, truth = [], [], {}
    for k in range(240):
        own = rng.sample(list(TERMS), rng.choice([1, 1, 2]))
        docs.append((k, " ".join(sentence(rng, s) for s in own for _ in range(5)) if k % 50 else ["", None][k % 100 == 0], "en" if k % 3 else None, "clash"))
        truth[k] = set(own) if k % 50 else set()
        if k < 120:
            labels += [(k, s if rng.random() > 0.05 else rng.choice(list(TERMS))) for s in own] + [(k, own[0])]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    subj = spark.createDataFrame([(s,) for s in TERMS] + [("never",)], "subject string")
    m = subjects.learn(d, lab, subj)
    got = {}
    for r in subjects.assign(d, m).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [k for k in range(120, 240)]
    assert sum(got.get(k, set()) == truth[k] for k in held) / len(held) >= 0.95
    assert subjects.assign(d.where("false"), m).count() == 0


def test_background_over_all_documents(spark):
    rng = random.Random(6)
    labelled = [(k, " ".join(sentence(rng, ["law", "sport"][k % 2]) + (" The harbour was quiet." if k % 2 else "") for _ in range(4)), "en") for k in range(40)]
    plain = [(100 + k, "The harbour was quiet. The harbour was quiet and old.", "en") for k in range(200)]
    lab = spark.createDataFrame([(k, ["law", "sport"][k % 2]) for k in range(40)], "doc_id long, subject string")
    subj = spark.createDataFrame([("law",), ("sport",)], "subject string")
    items = spark.createDataFrame([(f"zork{chr(97 + k)} zork{chr(97 + k)} zork{chr(97 + k)}.",) for k in range(20)], "text string")
    few, all_ = (subjects.learn(spark.createDataFrame(d, "doc_id long, text string, lang string"), lab, subj, items, max_docs=n) for d, n in ((labelled, 40), (labelled + plain, 40)))
    nats = lambda m, w, j: float(m.uni[0][m.words.index(w), j])
    assert nats(few, "harbour", 1) > 0.2 > 0 > nats(all_, "harbour", 1)
    assert nats(all_, "court", 0) > nats(few, "court", 0)
    docs = spark.createDataFrame(labelled + plain, "doc_id long, text string, lang string")
    got = subjects.background(docs, "text", all_)
    ws = [[w.lower() for x in subjects.sentence_words(t) for w in x] for _, t, _ in labelled + plain]
    assert got.total == [sum(map(len, ws))] and got.size == [len({w for x in ws for w in x})]
    assert {w: int(got.uni[0][all_.words.index(w)]) for w in ("the", "harbour", "court")} == {w: sum(x.count(w) for x in ws) for w in ("the", "harbour", "court")}
    x, y = all_.words.index("the"), all_.words.index("harbour")
    k = all_.pairs[0].tolist().index(x * len(all_.words) + y)
    assert got.bi[0][k] == sum(list(zip(s, s[1:])).count(("the", "harbour")) for _, t, _ in labelled + plain for s in [[w.lower() for w in q] for q in subjects.sentence_words(t)])
    assert all(all_.known[0][all_.words.index(f"zork{chr(97 + k)}")] for k in range(20))


def test_a_threshold_for_each_subject():
    import numpy as np

    e = subjects.Encoded([[["a"]]] * 60, subjects._Numbers({"a": 0}))
    score = np.zeros((60, 3))
    score[:30, 0], score[30:, 1] = 0.25, 0.05
    score[:10, 0] = 0.04  # weak and not labelled: the first subject needs more than the second
    may = np.zeros((60, 2), bool)
    may[10:30, 0], may[30:, 1] = True, True
    t = subjects._calibrate(score, e, may, 2)
    assert t[0] >= 0.06 > t[1]


def test_counts_of_characters(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert sum(r.n for r in encoding.bigram_counts(df, "t").collect()) > 0


def test_mixed_chapters_and_labels(spark, tmp_path):
    from quirelake.llm import queries

    text = {x: " ".join(SAY[x].format(f"Lum{i}") for i in range(8)) for x in SAY}
    books = [(i, x) for i, x in enumerate(SAY)] + [(90, None), (91, "English"), (92, "de")]
    rows = [(1000 + n * 100 + k, n, text[x].replace("Lum", f"Nor{k}")) for n, x in enumerate(SAY) for k in range(12)]
    rows += [(9000 + k, 0, text["en"]) for k in range(400)]  # copies draw once
    mixed = text["en"] + "\n\n" + SAY["ru"].format("b") * 2 + "\n\n" + text["en"]
    quoted = text["hu"] + " " + SAY["en"].format("c").split(".")[0] + "."
    rows += [(1, 90, text["ru"]), (2, 91, mixed), (3, 92, text["hu"]), (4, 92, quoted), (5, 92, None), (6, 91, "")]
    spark.createDataFrame(books, "id long, language string").write.parquet(f"{tmp_path}/books.parquet")
    spark.createDataFrame(rows, "id long, book_id long, content string").write.parquet(f"{tmp_path}/chapters.parquet")
    got = sorted((r.src, r.row_id, r.lang) for r in queries.p4_found(spark, str(tmp_path)).collect())
    assert got == [("books", 90, "ru"), ("books", 92, "hu"), ("chapters", 2, "en"), ("chapters", 2, "ru")]
