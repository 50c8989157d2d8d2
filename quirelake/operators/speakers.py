"""Who speaks: annotations spread over turns, dialogue maps, corrections, mentions, genders, consolidation."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def expand_turns(units: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Fills speaker_name of a turn's other units where the turn names exactly one; '' (narration) and names stay.

    ``units`` has chapter, turn_index (null outside turns) and speaker_name (null if not annotated).
    """
    w = Window.partitionBy(chapter, "turn_index")
    named = F.nullif(T.strip("speaker_name"), F.lit(""))
    one = F.when(F.col("turn_index").isNotNull() & (F.min(named).over(w) == F.max(named).over(w)), F.min(named).over(w))
    return units.withColumn("effective_speaker", F.coalesce("speaker_name", one))


def _said_by() -> re.Pattern:
    q, inner = '["“”„«»]', '[^"“”„«»]{2,}'
    said = f"(?:{P.SAID})"
    return re.compile(f"(?:{q}({inner}){q}\\s*[,.]?\\s*({P.NAME})\\s+{said}|({P.NAME})\\s+{said}\\s*[,.]?\\s*{q}({inner}){q})", re.S)


_SAID_BY, _QUOTED = _said_by(), re.compile(P.PAIRED_QUOTE)


def dialogue_map(text: str) -> dict[str, str]:
    """{beginning of what is said: who says it}, in order of first mention; of several mentions the last name holds."""
    return {k: v for m in _SAID_BY.finditer(text) for k, v in [((m[1] or m[4]).strip()[:60], (m[2] or m[3]).strip())]}


def speaker_of(sentence: str, said: dict[str, str]) -> str | None:
    """Who is named for the first quotation of a sentence: the first entry that contains it or is contained in it."""
    m = _QUOTED.search(sentence)
    snippet = m[0][1:-1].strip()[:60] if m else ""
    return next((who for what, who in said.items() if snippet in what or what in snippet), None) if snippet else None


def dialogue_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, snippet, speaker, pos): what is said by whom where name and verb stand beside a quotation.

    A snippet is the first 60 characters; of several mentions the last name holds and the first position.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, (m[1] or m[4]).strip()[:60], (m[2] or m[3]).strip(), i) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) if t for i, m in enumerate(_SAID_BY.finditer(t))]
            yield pd.DataFrame(rows, columns=[key, "snippet", "speaker", "pos"])

    found = df.select(key, text).mapInPandas(run, f"`{key}` {kind}, snippet string, speaker string, pos int")
    return found.groupBy(key, "snippet").agg(F.max_by("speaker", "pos").alias("speaker"), F.min("pos").alias("pos"))


def find_speakers(sentences: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Adds the speaker of the first map entry that contains, or is contained in, the sentence's first quotation."""
    s = sentences.withColumn("_snip", F.substring(T.strip(T.quote_inner("sentence")), 1, 60))
    p = pairs.select(F.col(key), "snippet", F.col("speaker").alias("_speaker"), F.col("pos").alias("_p"))
    hit = s.where("_snip <> ''").join(p, key).where("contains(snippet, _snip) OR contains(_snip, snippet)")
    best = hit.groupBy(key, "sentence_no").agg(F.min_by("_speaker", "_p").alias("speaker"))
    return s.drop("_snip").join(best, [key, "sentence_no"], "left")


def mentions(df: DataFrame, key: str, text: str, *order: str, top: int = 20) -> DataFrame:
    """(key, name, frequency): names before verbs of speech, and once more after quotations, the ``top`` most frequent.

    A key may have many texts, which ``order`` puts in sequence: each is read by itself and the counts are added up, so no long text is put together.
    """
    s = F.coalesce(F.col(text), F.lit(""))
    one = F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s+(?:" + P.MENTION_VERBS + r")\b"), 1)
    two = F.regexp_extract_all(s, F.lit(r'"[^"]{3,}"\s*[,.]?\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s+(?:' + P.QUOTE_VERBS + r")\b"), 1)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), one.alias("names")), F.struct(F.lit(1).alias("kind"), two.alias("names")))
    rows = df.select(key, *order, F.explode(kinds).alias("_m")).select(key, *order, "_m.kind", F.posexplode("_m.names").alias("at", "name"))
    n = rows.groupBy(key, "name").agg(F.count("*").alias("frequency"), F.min(F.struct("kind", *order, "at")).alias("pos"))
    rank = lambda: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("frequency"), "pos", "name"))
    n = n.withColumn("_r", rank()).where(F.col("_r") <= 2 * top).where(~F.col("name").isin(*P.MENTION_STOP) & (F.length("name") >= 2))
    return n.withColumn("_r", rank()).where(F.col("_r") <= top).select(key, "name", "frequency")


# Given names that are taken as male or female.
MALE = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew kenneth "
    "joshua kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin "
    "samuel raymond gregory frank alexander patrick jack dennis jerry tyler aaron henry jose adam douglas nathan peter zachary kyle walter arthur carl "
    "albert clarence ralph roy eugene wayne louis harry liam noah oliver elijah lucas mason ethan aiden logan caleb sebastian julian ezra miles finn leo "
    "theo max felix hugo oscar edgar ernest victor harold claude leon otto fred alfred gilbert roland benedict gabriel raphael dominic marcus julius "
    "sherlock watson holmes darcy heathcliff rochester pip fagin tom huck atticus gatsby dorian basil doyle dickens austen"
).split()
FEMALE = (
    "mary patricia jennifer linda barbara elizabeth susan jessica sarah karen lisa nancy betty margaret sandra ashley dorothy kimberly emily donna "
    "michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen "
    "samantha katherine christine debra rachel carolyn janet catherine maria heather diane julie joyce victoria kelly christina joan evelyn lauren "
    "judith olivia sophia isabella ava mia charlotte amelia harper abigail ella scarlett grace lily aria chloe penelope layla riley zoey nora luna "
    "eleanor violet aurora stella hazel alice claire audrey ruby jane anne edith mabel ethel florence beatrice cecily esme clarice eliza lydia "
    "marianne elinor harriet fanny hester hattie nell daisy molly flora rose iris vera pearl hermione ginny lavender parvati tonks narcissa "
    "bellatrix katniss primrose effie johanna clove glimmer rue"
).split()


def gender_by_name(name: Column | str) -> Column:
    first = F.lower(F.coalesce(F.try_element_at(T.words(name), F.lit(1)), F.lit("")))
    return F.when(first.isin(*MALE), "male").when(first.isin(*FEMALE), "female").otherwise("unknown")


_HE, _SHE, _ENDS = re.compile(r"\b(?:he|him|his)\b", re.I), re.compile(r"\b(?:she|her|hers)\b", re.I), re.compile(r"(?<=[.!?])\s+")
#: First names of a group that go with each of its texts at once.
NAMES_A_TEXT = 2_000


def gender_by_pronouns(names: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """(group, name, male, female, gender): pronouns in the sentences of the group's texts that contain the first name.

    Texts meet the first names of their group in blocks of bounded size; an automaton finds all names of a block in one pass over the sentences
    with pronouns, and counts are added up over texts.
    """
    n = names.select(group, "name", F.try_element_at(T.words("name"), F.lit(1)).alias("first")).where("first is not null").distinct()
    firsts = n.select(group, "first").distinct()
    many = firsts.groupBy(group).agg(F.ceil(F.count("*") / NAMES_A_TEXT).alias("_m"))
    blocks = firsts.join(many, group).groupBy(group, F.pmod(F.xxhash64("first"), "_m").alias("_b")).agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    kind = texts.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        made: dict = {}
        for b in batches:
            rows = []
            for g, text, block, words in b.itertuples(index=False, name=None):
                if (g, block) not in made:
                    if len(made) > 50:
                        made.clear()
                    made[g, block] = ahocorasick.Automaton()
                    for w in words:
                        made[g, block].add_word(w, w)
                    made[g, block].make_automaton()
                total: dict[str, list[int]] = {}
                for s in _ENDS.split(text or ""):
                    he, she = len(_HE.findall(s)), len(_SHE.findall(s))
                    for w in {w for _, w in made[g, block].iter(s)} if he or she else ():
                        c = total.setdefault(w, [0, 0])
                        c[0] += he
                        c[1] += she
                rows += [(g, w, he, she) for w, (he, she) in total.items()]
            yield pd.DataFrame(rows, columns=[group, "first", "he", "she"])

    got = texts.select(group, "text").join(blocks, group).select(group, "text", "_b", "firsts").mapInPandas(run, f"`{group}` {kind}, first string, he long, she long")
    got = got.groupBy(group, "first").agg(F.sum("he").alias("male"), F.sum("she").alias("female"))
    out = n.join(got, [group, "first"], "left").fillna(0, ["male", "female"]).select(group, "name", "male", "female")
    return out.withColumn("gender", F.when(F.col("male") > F.col("female"), "male").when(F.col("female") > F.col("male"), "female").otherwise("unknown"))


# The vocabulary of generated voices by gender, in the order in which they are drawn.
_AGES = {"male": ["young adult", "middle-aged", "elderly"], "female": ["young adult", "middle-aged"], "": ["child", "teenager", "young adult", "middle-aged", "elderly"]}
_PITCHES = {"male": ["very low pitch", "low pitch", "moderate pitch"], "female": ["moderate pitch", "high pitch", "very high pitch"], "": ["low pitch", "moderate pitch", "high pitch"]}
_ACCENTS = ["american accent", "british accent", "australian accent", "canadian accent", "indian accent"]


def voice_of(name: str, gender: str) -> str:
    """The voice a name always gets: draws of a generator seeded by its digest."""
    draw = random.Random(int(hashlib.md5(name.lower().encode()).hexdigest(), 16)).choice
    known = gender if gender in ("male", "female") else ""
    age, pitch = draw(_AGES[known]), draw(_PITCHES[known])
    sex = known or draw(["male", "female"])
    return ", ".join((sex, age, pitch, draw(_ACCENTS)))


def voices(df: DataFrame, name: str, gender: str) -> DataFrame:
    """Adds instruct and color_hex."""
    made = F.pandas_udf(lambda n, g: pd.Series([voice_of(a, b or "unknown") if a is not None else None for a, b in zip(n, g)]), "string")
    return df.withColumn("instruct", made(name, gender)).withColumn("color_hex", T.voice_colour(name))


def corrections(units: DataFrame, commands: DataFrame) -> DataFrame:
    """(chapter_id, unit_index, speaker_name, confidence, source): the manual annotations that commands make, at most one command a chapter.

    ``units`` has chapter_id, unit_index, turn_index, dialogue_candidate and effective_speaker; ``commands`` chapter_id, at, scope ('sentence',
    'turn', 'turn_tail', 'range'), speaker ('' for narration) and end. A turn's scopes on a unit without turn mean the sentence. A range covers at most 201 units;
    it also clears the run of units behind it that the same speaker holds. A command that is malformed makes nothing.
    """
    c = commands.select("chapter_id", F.col("at").alias("_at"), F.col("scope").alias("_scope"), F.coalesce("speaker", F.lit("")).alias("_who"), F.col("end").alias("_end"))
    rows = units.join(c, "chapter_id")
    here = F.col("unit_index") == F.col("_at")
    turn = rows.where(here).select("chapter_id", F.col("turn_index").alias("_t"))
    rows = rows.join(turn, "chapter_id")
    near = (F.col("turn_index") == F.col("_t")) & F.col("dialogue_candidate") | (F.col("_t").isNull() & here)
    span = F.coalesce((F.col("_end") - F.col("_at")).between(0, 200), F.lit(False))
    chosen = (
        F.when(F.col("_scope") == "sentence", here).when(F.col("_scope") == "turn", near)
        .when(F.col("_scope") == "turn_tail", near & (F.col("unit_index") >= F.col("_at"))).when(F.col("_scope") == "range", span & F.col("unit_index").between(F.col("_at"), F.col("_end")))
    )
    tail = (F.col("_scope") == "range") & span & (F.col("_who") != "") & (F.col("unit_index") > F.col("_end"))
    other = ~F.lower(T.strip(F.coalesce("effective_speaker", F.lit("")))).eqNullSafe(F.lower("_who"))
    stop = rows.where(tail & other).groupBy("chapter_id").agg(F.min("unit_index").alias("_stop"))
    rows = rows.join(stop, "chapter_id", "left")
    clear = tail & (F.col("_stop").isNull() | (F.col("unit_index") < F.col("_stop")))
    out = rows.where(F.coalesce(chosen, F.lit(False)) | clear).withColumn("speaker_name", F.when(F.coalesce(chosen, F.lit(False)), F.col("_who")).otherwise(""))
    return out.select("chapter_id", "unit_index", "speaker_name", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"))


def correct(units: DataFrame, command: dict) -> DataFrame:
    """``corrections`` for one command, with chapter_id, unit_index, scope, speaker and end_index; a range out of bounds is an error."""
    at, end = command["unit_index"], command.get("end_index")
    if command["scope"] == "range" and not (end is not None and 0 <= end - at <= 200):
        raise ValueError("a range covers at most 201 units, in order")
    rows = units.where(F.col("chapter_id") == command["chapter_id"])
    one = [(command["chapter_id"], at, command["scope"], command.get("speaker") or "", end)]
    kind = units.schema["chapter_id"].dataType.simpleString()
    return corrections(rows, units.sparkSession.createDataFrame(one, f"chapter_id {kind}, at int, scope string, speaker string, end int"))


def find_or_create(characters: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book_id, name, canonical, id, gender, instruct, color_hex): the character each wanted name means.

    A stored name that differs only in the case of A-Z keeps its spelling (of several the oldest); else a new one, id null, of unknown
    gender, with the voice its name always gets.
    """
    k = characters.withColumn("_k", T.fold_ascii("name")).groupBy("book_id", "_k").agg(F.min_by(F.struct("id", "name", "gender", "instruct", "color_hex"), "id").alias("c"))
    w = wanted.select("book_id", "name").where("name is not null and name <> ''").distinct().withColumn("_k", T.fold_ascii("name"))
    rows = w.join(k, ["book_id", "_k"], "left").select("book_id", "name", F.col("c.name").alias("stored"), F.col("c.id").alias("id"), F.col("c.gender").alias("g"), F.col("c.instruct").alias("i"), F.col("c.color_hex").alias("h"))
    rows = voices(rows.withColumn("gender", F.when(F.col("id").isNull(), "unknown").otherwise(F.col("g"))), "name", "gender")
    old = F.col("id").isNotNull()
    return rows.select("book_id", "name", F.coalesce("stored", "name").alias("canonical"), "id", "gender", F.when(old, F.col("i")).otherwise(F.col("instruct")).alias("instruct"), F.when(old, F.col("h")).otherwise(F.col("color_hex")).alias("color_hex"))


def labelled(segments: DataFrame, group: str, order: str) -> DataFrame:
    """Adds show_label: whether a speaker's label stands before a segment.

    Needs unit_index, speaker_candidate, speaker_continuation, character_name and speaker_source. Narration is labelled where it was set by
    hand or follows speech; a continued turn of one speaker is not labelled again.
    """
    w = Window.partitionBy(group).orderBy(order)
    who, before = F.nullif("character_name", F.lit("")), F.nullif(F.lag("character_name").over(w), F.lit(""))
    narration = who.isNull() & ((F.coalesce("speaker_source", F.lit("")) == "manual") | before.isNotNull())
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0
    goes_on = flag("speaker_continuation") & who.isNotNull() & F.coalesce(before == who, F.lit(False))
    return segments.withColumn("show_label", F.col("unit_index").isNotNull() & (flag("speaker_candidate") | who.isNotNull() | narration) & ~goes_on)


def nearest_to(rows: DataFrame, group: str, order: str, middle: Column, target: Column) -> DataFrame:
    """(group, order): the row of each group whose middle is nearest to the target, the first of equals."""
    d = F.struct(F.abs(middle - target).alias("d"), F.col(order).alias("o"))
    return rows.groupBy(group).agg(F.min(d).alias("m")).select(group, F.col("m.o").alias(order))


def recount(characters: DataFrame, annotations: DataFrame) -> DataFrame:
    """frequency = the book's annotations whose speaker is the name, without case of A-Z."""
    n = annotations.groupBy("book_id", T.fold_ascii("speaker_name").alias("_k")).agg(F.count("*").alias("_n"))
    out = characters.withColumn("_k", T.fold_ascii("name")).join(n, ["book_id", "_k"], "left")
    return out.withColumn("frequency", F.coalesce("_n", F.lit(0)).cast("int")).drop("_k", "_n")


def consolidate(counts: DataFrame, group: str) -> DataFrame:
    """(group, name, target): a shorter name goes to the one longer name that has all its words, or to the dominant one.

    Names are visited from short to long and counts move on, so a group is one fold; a group is the cast of one
    book, already reduced to its distinct names.
    """
    kind = counts.schema[group].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["name"])
        n = dict(zip(pdf["name"], pdf["frequency"].astype(int)))
        words = {x: {w.casefold() for w in re.findall(r"\w+", x)} for x in n}
        by_word: dict[str, set[str]] = {}
        for x, ws in words.items():
            for w in ws:
                by_word.setdefault(w, set()).add(x)
        to: dict[str, str] = {}
        for short in sorted(n, key=lambda x: (len(x), x)):
            ws = words[short]
            if not ws or short in to:
                continue
            longer = set.intersection(*(by_word[w] for w in ws)) - to.keys()
            fits = sorted((x for x in longer if len(x) > len(short)), key=lambda x: (-n[x], x))
            if not fits or len(fits) > 1 and n[fits[0]] < max(3, 2 * n[fits[1]]):
                continue
            to[short] = fits[0]
            n[fits[0]] += n[short]

        def last(x: str) -> str:
            while x in to:
                x = to[x]
            return x

        return pd.DataFrame({group: pdf[group], "name": pdf["name"], "target": [last(x) for x in pdf["name"]]})

    return counts.groupBy(group).applyInPandas(fold, f"`{group}` {kind}, name string, target string")


def replies(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, pos, unit_id, speaker) of the dialogues of a model's JSON replies; fences off, first valid row of an id wins."""
    body = F.regexp_replace(F.trim(F.col(reply)), "^```(?:json)?\\s*|\\s*```$", "")
    parsed = F.from_json(body, "struct<dialogues:array<string>,characters:array<struct<name:string,gender:string,aliases:array<string>>>>")
    rows = df.select(key, F.posexplode(F.coalesce(parsed["dialogues"], F.array().cast("array<string>"))).alias("pos", "d"))
    parts = F.split("d", "\\|", 2)
    rows = rows.select(key, "pos", F.try_element_at(parts, F.lit(1)).try_cast("int").alias("unit_id"), T.clean_speaker(F.try_element_at(parts, F.lit(2))).alias("speaker"))
    w = Window.partitionBy(key, "unit_id").orderBy("pos")
    return rows.where("unit_id is not null and speaker <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
