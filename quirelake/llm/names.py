"""Variant spellings of names within a group, such as the cast of a book (problem 5).

Names are cleaned (encoding repaired, consistent form, titles off, "Surname, Given" turned round) and cut into tokens. A symmetric-delete
index on tokens finds spellings one edit apart: every token is filed under itself and each form with
one character deleted, joined with the initial of another token, so a key is shared by few names. Names that share
a key are compared by optimal assignment of their tokens, which permits initials, abbreviations, nicknames and
one edit in all. Names with a single telling token (a surname or first name alone, also with title or
initial) are linked afterwards, and only if all full names they fit mean one and the same.

Spellings that read alike (case, titles, order) are one form, and forms are compared, not spellings. Everything is a join on (group, key):
no group is collected. Components are found by minimum-label propagation with
checkpoints. Null, blank and placeholder names ('Narrator', 'Unknown') name nobody; repeated rows count
once; a name that fits two different people is linked to neither. Single tokens that fit no full name are compared with each other in the
same way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release, spread
from . import encoding
from .index import deletes
from .textform import fold_str

# Forms of address, stripped from a name.
TITLES = set(
    "mr mrs ms miss mister dr prof professor sir lady lord madam rev capt captain herr frau hr fr fräulein señor señora señorita don doña sr sra srta dra "
    "dom dona senhor senhora monsieur madame mademoiselle mme mlle özv ifj id úr asszony г-н г-жа господин госпожа श्री श्रीमती जी डॉ कुमारी साहब "
    "先生 小姐 女士 太太 さん 様 さま 君 くん ちゃん 殿 氏".split()
)
_SUFFIX = re.compile("(?:先生|小姐|女士|太太|さん|様|さま|くん|ちゃん|殿)$")
PLACEHOLDERS = {"", "narrator", "unknown"}
# Short and pet forms of first names, by language.
NICKNAMES: dict[str, str] = {
    "abigail": "abby abbie gail", "benedict": "ben benny", "catherine": "cathy kate katie kitty cat", "elizabeth": "liz lizzie beth betty eliza bess betsy", "frederick": "fred freddie freddy",
    "gwendolyn": "gwen wendy", "josephine": "jo josie joey", "leonard": "len lenny leo", "margaret": "maggie meg peggy madge greta", "nathaniel": "nat nate nathan",
    "richard": "rick dick rich richie", "robert": "rob bob bobby robbie", "rosalind": "ros rosie roz linda", "theodora": "thea dora theo teddy", "william": "will bill billy willie liam",
    "winifred": "winnie freda win", "chloé": "chlo", "søren": "sør", "james": "jim jimmy jamie", "thomas": "tom tommy", "edward": "ed eddie ned ted", "john": "jack johnny", "charles": "charlie chuck", "henry": "harry hank",
    "michael": "mike mickey", "anthony": "tony", "alexander": "alex sandy", "samuel": "sam sammy", "joseph": "joe joey", "daniel": "dan danny", "andrew": "andy drew", "susan": "sue suzy", "dorothy": "dot dolly", "mary": "molly polly",
    "erzsébet": "erzsi bözsi böske zsóka erzsike", "ferenc": "feri ferkó", "gergő": "geri gergely", "győző": "győzike", "hajnalka": "hajni", "ilona": "ica ilka ili ilus", "istván": "pista pisti", "jenő": "jenci", "józsef": "jóska józsi",
    "katalin": "kata kati katica", "kálmán": "kálmi", "lászló": "laci lacika", "mária": "mari marika", "piroska": "piri", "sándor": "sanyi sanyika", "zsuzsanna": "zsuzsi zsuzsa", "bálint": "bálintka", "anna": "panni annus anni",
    "elisabeth": "lisa elli elsa lisbeth liesl sisi else", "friedrich": "fritz friedel", "johannes": "hannes hans", "katharina": "kathrin kati käthe katrin", "margarete": "gretel grete greta", "matthias": "matze mattes hias", "sebastian": "basti bastian", "wilhelm": "willi willy", "günther": "günni", "jürgen": "jürg",
    "élisabeth": "lisette babette élise lise", "françois": "fanfan", "frédéric": "fred frédo", "geneviève": "ginette gégé", "hélène": "léna", "joséphine": "josette josé josée fifine", "marguerite": "margot", "mathieu": "mat matt", "théodore": "théo", "édouard": "édou doudou", "benoît": "ben",
    "asunción": "asun", "concepción": "concha conchita", "dolores": "lola loli", "francisco": "paco pancho curro", "guadalupe": "lupe lupita", "ignacio": "nacho", "jesús": "chus suso", "josé": "pepe zé pepito", "inés": "inesita", "martín": "tin", "ángela": "angelines",
    "antônio": "toninho tonho", "beatriz": "bia", "conceição": "são ção", "joão": "joãozinho", "lúcia": "luci lu", "simão": "sima", "estêvão": "tevo", "inês": "nês",
    "александр": "саша шура", "алексей": "алёша лёша", "владимир": "володя вова", "дмитрий": "дима митя", "иван": "ваня", "михаил": "миша", "николай": "коля", "павел": "паша", "семён": "сеня",
}


def _plain(token: str) -> str:
    """Small letters without accents."""
    flat = "".join(c for c in unicodedata.normalize("NFD", token.casefold()) if not unicodedata.combining(c) or "ऀ" <= c <= "ॿ")
    return flat.replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d")


_FULL_OF: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL_OF.setdefault(_plain(fold_str(_s)), set()).add(_plain(fold_str(_full)))
#: Words of joining or of form in the names of firms.
_AND = {"and", "und", "et", "y", "e", "és", "и", "&"}
#: Words of form that a firm's name may go without.
FORMS = set("company co corp corporation ltd inc limited tarsasag tars gesellschaft ges gmbh ag rt kft cie compagnie compania cia companhia societe ooo компания общество".split())
_EAST = re.compile("[぀-ヿ㐀-鿿]")


def _consistent(s: str) -> str:
    """The consistent form; most names are in it already and are not sent through the arrays one by one."""
    same = s.isascii() or unicodedata.is_normalized("NFC", s) and not any(map(encoding._foldable, s))
    return s if same else fold_str(s)


@lru_cache(200_000)
def parse(name: str) -> tuple[tuple[tuple[str, bool], ...], bool]:
    """((token, is it an abbreviation), ...) and whether a form of address was stripped."""
    s = _consistent(name.lower()).replace("_", " ").replace("・", " ").strip()  # small letters first: look-alikes differ by case
    if s.count(",") == 1:
        a, b = s.split(",")
        s = b.strip() + " " + a.strip()
    s = re.sub(r"(?<=\w)[-–—](?=\w)", " ", s)
    if _EAST.search(s):
        t = _SUFFIX.sub("", s.replace(" ", "") if _SUFFIX.search(s) else s)
        parts = [p for p in t.split() if p not in TITLES]
        return tuple((p, False) for p in parts), len(t) != len(s)
    out, titled = [], False
    words = [w for w in re.split(r"[\s]+|(?<=\.)(?=\w)", s) if w]
    for w in words:
        bare = w.strip(".,;:'\"“”‘’!?()")
        low = bare.casefold()
        if not low or low in _AND and (len(low) > 1 and len(words) > 2 or low == "&" or len(low) == 1 and not w.endswith(".") and len(words) > 3):
            continue
        if low in TITLES and not (len(low) == 1 and len(words) < 2) and not (len(bare) == 1 and w.endswith(".") and len(words) > 2 and w is not words[0]):
            titled = True
            continue
        if low in ("the", "a") and len(words) > 2 and w is words[0]:
            continue
        p = _plain(bare)
        out.append((p, w.endswith(".") or len(p) == 1))
    return tuple(out), titled


def one_edit(a: str, b: str) -> bool:
    """Whether two tokens are at most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def token_cost(x: tuple[str, bool], y: tuple[str, bool]) -> float:
    """0 for the same, small for initial, abbreviation and nickname, 1 for one edit, 9 for different tokens."""
    (a, short_a), (b, short_b) = x, y
    if a == b:
        return 0.0
    if short_a and b.startswith(a) or short_b and a.startswith(b):
        return 0.1
    if len(min(a, b, key=len)) == 1:
        return 9.0
    if b in _FULL_OF.get(a, ()) or a in _FULL_OF.get(b, ()) or _FULL_OF.get(a, set()) & _FULL_OF.get(b, set()):
        return 0.1
    if min(len(a), len(b)) >= 4 and one_edit(a, b):
        return 1.0
    if min(len(a), len(b)) >= 2 and len(a) != len(b) and max(len(a), len(b)) <= 4 and one_edit(a, b):
        return 1.0
    return 9.0


def assign(a: tuple, b: tuple) -> tuple[float, int]:
    """(cost, whole tokens matched) of the cheapest assignment of the shorter name's tokens to the longer one's.

    Shortest augmenting paths, so names of any length are assigned optimally; of equal costs the one with more whole tokens.
    """
    if len(a) > len(b):
        a, b = b, a
    pair = [[token_cost(x, y) for y in b] for x in a]
    if any(min(r) >= 9 for r in pair):
        return 99.0, 0
    whole = [[len(x[0]) > 1 and len(y[0]) > 1 and c < 9 for y, c in zip(b, r)] for x, r in zip(a, pair)]
    left = [0.1 if y[1] and len(y[0]) == 1 or y[0] in FORMS else 9.0 for y in b]  # of a token without partner
    cost = [[c - p - 1e-6 * w for c, p, w in zip(r, left, v)] for r, v in zip(pair, whole)]
    n, m, inf = len(a), len(b), float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            row, step, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    total = sum(pair[match[j] - 1][j - 1] if match[j] else left[j - 1] for j in range(1, m + 1))
    return total, sum(whole[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j])


def same(x: str, y: str) -> bool:
    """Whether two names of at least two tokens, or written together, mean the same."""
    (a, _), (b, _) = parse(x), parse(y)
    if not a or not b:
        return False
    ja, jb = {"".join(t for t, _ in o) for o in (a, a[::-1])}, {"".join(t for t, _ in o) for o in (b, b[::-1])}
    east = _EAST.search(x) or _EAST.search(y)
    if ja & jb:
        return True
    if east:
        return any(len(p) >= 4 and len(p) != len(q) and one_edit(p, q) for p in ja for q in jb)
    if len(a) == 1 or len(b) == 1:
        return any(len(p) >= 8 and one_edit(p, q) for p in ja for q in jb) and max(len(a), len(b)) > 1
    if len({t for t, s in a if s and len(t) == 1} | {t for t, s in b if s and len(t) == 1}) > 1 and len(a) > 2 and len(b) > 2:
        return False  # different middle initials
    cost, whole = assign(a, b)
    return cost < 1.9 and whole >= 2


def _run_together(name: str) -> bool:
    """Whether the name looks like given name and surname written as one word."""
    s = name.strip()
    return len(s) >= 8 and s.islower() and s.isalpha() and not _EAST.search(s)


def kind(name: str) -> str:
    """'full' for at least two telling tokens or a long single one, 'part' for one, '' for none."""
    tokens, _ = parse(name)
    if not tokens or name.strip().casefold() in PLACEHOLDERS:
        return ""
    if _run_together(name):
        return "full"
    if _EAST.search(name):
        return "full" if len("".join(t for t, _ in tokens)) >= 4 else "part"
    telling = [t for t, short in tokens if not (short and len(t) == 1)]
    return "full" if len(telling) >= 2 else "part" if telling else ""


@lru_cache(200_000)
def _deletes(t: str) -> frozenset[str]:
    return frozenset(deletes(t) if len(t) >= 3 else [t])


def _initials(t: str) -> set[str]:
    return {t[:1], *(f[:1] for f in _FULL_OF.get(t, ()))}


def keys(name: str) -> list[str]:
    """Keys of the symmetric-delete index: a token's deletes with another token's initial; the whole name's deletes."""
    tokens, _ = parse(name)
    out: set[str] = set()
    for order in {tokens, tokens[::-1]}:
        joined = "".join(t for t, _ in order)
        if len(joined) >= 4:
            out |= {"*" + d for d in _deletes(joined)}
    if not _EAST.search(name):
        whole = [(t, s) for t, s in tokens if len(t) > 1]
        for i, (t, short) in enumerate(whole):
            if short and len(t) < 4:
                continue
            for j, (u, _) in enumerate(whole):
                if i != j:
                    out |= {f"{d}|{c}" for d in _deletes(t) for c in _initials(u)}
    return sorted(out)


def part_keys(name: str, full: bool) -> list[str]:
    """Keys under which a single-token name meets full names: the token, one edit of it, its full forms."""
    tokens, _ = parse(name)
    out: set[str] = set()
    if _EAST.search(name):
        for s in [t for t, _ in tokens] + ["".join(t for t, _ in tokens)]:
            out |= {s} if not full else {s[i:j] for i, j in ((0, k) for k in range(2, len(s) + 1))} | {s[k:] for k in range(0, len(s) - 1)}
        return sorted(out)
    if full and _run_together(name):
        t = tokens[0][0]
        return sorted({t[:k] for k in range(3, len(t))} | {t[k:] for k in range(1, len(t) - 2)})
    for t, short in tokens:
        if len(t) > 1:
            out |= {t, *_FULL_OF.get(t, ())} if not full else {t}
            if len(t) >= 5:
                out |= {"~" + d for d in _deletes(t)}
            if full:
                out |= {t[:k] + "." for k in range(2, min(len(t), 6))}
            elif short:
                out.add(t + ".")
    return sorted(out)


def fits(part: str, full: str) -> int:
    """2 if a name with one telling token can mean the bearer of a full name, 1 if so once a leading 'M.' is read as a title, else 0."""
    if _fits(part, full):
        return 2
    return int(bool(re.match(r"\s*M\.\s*\w", part)) and _fits(re.sub(r"^\s*M\.\s*", "", part), full))


def _fits(part: str, full: str) -> bool:
    (a, _), (b, _) = parse(part), parse(full)
    if _EAST.search(part):
        s, f = "".join(t for t, _ in a), "".join(t for t, _ in b)
        return len(s) >= 2 and (f.startswith(s) or f.endswith(s))
    if _run_together(full):
        s, whole = b[0][0], [t for t, _ in a if len(t) > 1]
        rest = [t for t, _ in a if len(t) == 1]
        return len(whole) == 1 and any(
            s.startswith(w) and all(s[len(w) :].startswith(r) for r in rest) or s.endswith(w) and all(s.startswith(r) for r in rest) for w in whole if len(w) < len(s)
        ) or len(a) == 2 and any(s.startswith(x) and s.endswith(y) for (x, _), (y, _) in ((a[0], a[1]), (a[1], a[0])))
    used: set[int] = set()
    for t in sorted(a, key=lambda t: -len(t[0])):
        best = min(((token_cost(t, u), j) for j, u in enumerate(b) if j not in used), default=(9.0, -1))
        if best[0] > (1.0 if len(t[0]) >= 5 else 0.5):
            return False
        used.add(best[1])
    return True


def lone_keys(name: str) -> list[str]:
    """Keys under which single tokens without a full name meet: the tokens, their full forms, one edit of a long one."""
    out: set[str] = set()
    for t, _ in parse(name)[0]:
        if len(t) > 1:
            out |= {t, *_FULL_OF.get(t, ())}
            if len(t) >= LONE:
                out |= {"~" + d for d in _deletes(t)}
    return sorted(out)


#: Length from which single tokens that differ by one edit count as one name.
LONE = 6


def alike(x: str, y: str) -> int:
    """2 if two names with one telling token are the same but for form, 1 if one is a short form of the other or one edit apart, else 0."""
    a, b = (sorted(t for t, _ in parse(n)[0] if len(t) > 1) for n in (x, y))
    if a == b:
        return 2
    if len(a) != 1 or len(b) != 1:
        return 0
    if a[0] in _FULL_OF.get(b[0], ()) or b[0] in _FULL_OF.get(a[0], ()):
        return 1
    return int(min(len(a[0]), len(b[0])) >= LONE and a[0][0] == b[0][0] and one_edit(a[0], b[0]))


def _form(clean: str) -> str:
    """What decides with whom a spelling is linked: its tokens, and the traits of the spelling that the comparisons look at."""
    return repr((parse(clean)[0], _run_together(clean), bool(_EAST.search(clean)), bool(re.match(r"\s*M\.\s*\w", clean))))


def _components(links: DataFrame) -> DataFrame:
    """(g, name, root): connected components of (g, a, b) links by minimum labels and pointer jumping."""
    both = durable(links.select("g", "a", "b").unionByName(links.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = durable(both.groupBy("g", F.col("a").alias("name")).agg(F.min("b").alias("m")).select("g", "name", F.least("name", "m").alias("root")))
    while True:
        near = both.join(label.select("g", F.col("name").alias("b"), F.col("root").alias("r")), ["g", "b"]).groupBy("g", F.col("a").alias("name")).agg(F.min("r").alias("r"))
        step = label.join(near, ["g", "name"]).select("g", "name", F.least("root", "r").alias("new"), F.col("root").alias("old"))
        up = step.select("g", F.col("name").alias("new"), F.col("new").alias("up"))
        step = step.join(up, ["g", "new"], "left").select("g", "name", F.least(F.col("new"), F.coalesce("up", "new")).alias("root"), "old")
        step = durable(step)
        done = step.where("root <> old").isEmpty()
        release(label)
        label = step.drop("old")
        if done:
            release(both)
            return label


def _unambiguous(links: DataFrame, free: DataFrame) -> DataFrame:
    """(g, form, root) of single tokens: those alike but for form are one; of the rest only tokens whose near ones are all one are linked."""
    roots = _components(links.where("sure = 2").select("g", "a", "b"))
    roots = durable(free.join(roots.withColumnRenamed("name", "form"), ["g", "form"], "left").select("g", "form", F.coalesce("root", "form").alias("root")))
    x, y = roots.toDF("g", "a", "ra"), roots.toDF("g", "b", "rb")
    near = links.where("sure = 1").join(x, ["g", "a"]).join(y, ["g", "b"]).where("ra <> rb").select("g", "ra", "rb")
    near = near.unionByName(near.select("g", F.col("rb").alias("ra"), F.col("ra").alias("rb"))).distinct()
    one = near.groupBy("g", "ra").agg(F.min("rb").alias("rb"), F.count("*").alias("n")).where("n = 1").drop("n")
    # both must be each other's only near one, so no chain is formed
    pairs = one.join(one.select("g", F.col("ra").alias("rb"), F.col("rb").alias("ra")), ["g", "ra", "rb"]).select("g", F.col("ra").alias("root"), F.least("ra", "rb").alias("to"))
    return roots.join(pairs, ["g", "root"], "left").select("g", "form", F.coalesce("to", "root").alias("root"))


def variant_classes(names: DataFrame, group: str, name: str, model: encoding.Plausibility | None = None) -> DataFrame:
    """(group, ``name``, class_id, spellings): the class of each distinct spelling that names someone, and how many spellings it has."""
    spark = names.sparkSession
    gk = names.schema[group].dataType.simpleString()
    base = names.select(F.col(group).alias("g"), F.col(name).alias("name")).where(F.col(group).isNotNull() & F.col(name).isNotNull()).distinct()
    shared = spark.sparkContext.broadcast(model.pairs if model else None)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, memo = encoding.Plausibility(shared.value) if shared.value else None, {}
        for b in batches:
            rows = []
            if own:
                encoding.prepare(b["name"], own, memo)
            for g, n in zip(b["g"], b["name"]):
                clean = encoding.repair(n, own, memo)[0] if own else n
                k = kind(clean) if n.strip().casefold() not in PLACEHOLDERS else ""
                if k:
                    rows.append((g, n, clean, k, _form(clean)))
            yield pd.DataFrame(rows, columns=["g", "name", "clean", "kind", "form"])

    spelled = spread(base, "g", "name").mapInPandas(read, f"g {gk}, name string, clean string, kind string, form string")
    spelled = durable(spelled.withColumn("form", F.xxhash64("g", "kind", "form")))
    forms = spelled.groupBy("g", "form", "kind").agg(F.min("clean").alias("clean"))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, f, k, c in zip(b["g"], b["form"], b["kind"], b["clean"]):
                rows.append((g, f, k, c, keys(c) if k == "full" else [], part_keys(c, k == "full"), lone_keys(c) if k == "part" else []))
            yield pd.DataFrame(rows, columns=["g", "form", "kind", "clean", "keys", "part_keys", "lone_keys"])

    # the index holds two hashes a row; whoever meets by a collision fails the test on the names themselves
    filed = durable(spread(forms.select("g", "form", "kind", "clean"), "g", "form").mapInPandas(file, f"g {gk}, form long, kind string, clean string, keys array<string>, part_keys array<string>, lone_keys array<string>"))
    who = filed.select("g", "form", "clean")

    def index(rows: DataFrame, keys: str) -> DataFrame:
        rows = rows.select("g", "form", F.explode(keys).alias("k"))
        return rows.select("form", F.xxhash64("g", "k").alias("h"))

    def met(pairs: DataFrame, test) -> DataFrame:
        """(g, a, b, sure) of the pairs of forms whose names pass the test."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["sure"] = [int(test(x, y)) for x, y in zip(b["ca"], b["cb"])]
                yield b[b["sure"] > 0][["g", "a", "b", "sure"]]

        a = who.select(F.col("form").alias("a"), "g", F.col("clean").alias("ca"))
        b = who.select(F.col("form").alias("b"), F.col("g").alias("g2"), F.col("clean").alias("cb"))
        return pairs.join(a, "a").join(b, "b").where("g = g2").select("g", "a", "b", "ca", "cb").mapInPandas(run, f"g {gk}, a long, b long, sure int")

    def within(rows: DataFrame, keys: str) -> DataFrame:
        x = index(rows, keys)
        return x.withColumnRenamed("form", "a").join(x.withColumnRenamed("form", "b"), "h").where("a < b").select("a", "b").distinct()

    full, lone = filed.where("kind = 'full'"), filed.where("kind = 'part'")
    roots = _components(met(within(full, "keys"), lambda x, y: same(x, y)))
    roots = durable(full.select("g", "form").join(roots.withColumnRenamed("name", "form"), ["g", "form"], "left").select("g", "form", F.coalesce("root", "form").alias("root")))
    # single tokens: all full names they fit must be of one root
    pairs = index(lone, "part_keys").withColumnRenamed("form", "a").join(index(full, "part_keys").withColumnRenamed("form", "b"), "h").select("a", "b").distinct()
    fit = met(pairs, lambda x, y: fits(x, y)).join(roots.select("g", F.col("form").alias("b"), "root"), ["g", "b"])
    fit = fit.groupBy("g", "a", "sure").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    fit = durable(fit.groupBy("g", "a").agg(F.max(F.struct("sure", "root", "other")).alias("x")).select("g", F.col("a").alias("form"), "x.root", "x.other"))
    placed = fit.where("root = other").select("g", "form", "root")
    free = durable(lone.join(fit.select("g", "form"), ["g", "form"], "left_anti"))
    links = durable(met(within(free, "lone_keys"), lambda x, y: alike(x, y)))
    alone = _unambiguous(links, free.select("g", "form"))
    member = durable(spelled.select("g", "form", "name").join(roots.unionByName(placed).unionByName(alone), ["g", "form"]).select("g", "name", "root"))
    size = member.groupBy("g", "root").agg(F.count("*").alias("spellings"))
    return member.join(size, ["g", "root"]).select(F.col("g").alias(group), F.col("name").alias(name), F.col("root").alias("class_id"), "spellings")


def variant_pairs(names: DataFrame, group: str, name: str, model: encoding.Plausibility | None = None) -> DataFrame:
    """(group, name_a, name_b), name_a < name_b by code points: pairs of spellings of one class."""
    member = variant_classes(names, group, name, model).where("spellings > 1").select(group, "class_id", name)
    x, y = member.withColumnRenamed(name, "name_a"), member.withColumnRenamed(name, "name_b")
    return x.join(y, [group, "class_id"]).where("name_a < name_b").select(group, "name_a", "name_b")
