"""Who speaks, asked of a language model: batches, prompts, replies, and the cast they add up to.

The model is a callable from a prompt to a reply; failures are exceptions. Books run in parallel, the batches of a book in order, as
each prompt names the cast found so far.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .schedule import packs

LEAST_BATCH, ROSTER = 10_000, 20
GENDERS = ("male", "female", "unknown")


def batches(units: DataFrame, chapters: DataFrame, most: int = LEAST_BATCH) -> DataFrame:
    """(book_id, chapter_id, order_num, size, pack_no): chapters in order fill a batch until the next would pass its characters.

    ``units`` has chapter_id and unit_text, ``chapters`` chapter_id, book_id, order_num; a chapter over the limit is a batch of its own.
    """
    size = units.groupBy("chapter_id").agg(F.sum(F.length(F.coalesce("unit_text", F.lit("")))).alias("size"))
    rows = chapters.select("book_id", "chapter_id", "order_num").join(size, "chapter_id").select("book_id", "chapter_id", "order_num", "size")
    return packs(rows, ["book_id"], ["order_num", "chapter_id"], "size", 1 << 30, max(LEAST_BATCH, int(most)))


def numbered(units: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds request_id, the number of a unit in its batch, and line, the unit as the prompt shows it."""
    rows = units.join(batch.select("book_id", "chapter_id", "order_num", "pack_no"), "chapter_id")
    w = Window.partitionBy("book_id", "pack_no").orderBy("order_num", "chapter_id", "unit_index")
    rows = rows.withColumn("request_id", F.row_number().over(w) - 1)
    kind = F.when(F.col("dialogue_candidate"), "D").otherwise("N")
    return rows.withColumn("line", F.concat(F.lit("["), kind, F.lit(" "), F.col("request_id").cast("string"), F.lit("] "), F.coalesce("unit_text", F.lit(""))))


def prompt_texts(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, pack_no, prompt_units): the numbered units of a batch under the titles of their chapters (chapter_id, title)."""
    rows = lines.groupBy("book_id", "pack_no", "chapter_id", "order_num").agg(_ordered("line", "\n", "request_id").alias("body"))
    rows = rows.join(titles.select("chapter_id", F.coalesce("title", F.lit("")).alias("title")), "chapter_id")
    block = F.concat(F.lit("\n=== CHAPTER: "), F.col("title"), F.lit(" ===\n"), F.col("body"))
    return rows.withColumn("block", block).groupBy("book_id", "pack_no").agg(_ordered("block", "\n", "order_num", "chapter_id").alias("prompt_units"))


def _ordered(value: str, glue: str, *order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]), glue)


def unwrapped(reply: Column | str) -> Column:
    """struct(body, problem) of a chat reply: its content, whole or in parts, without fence; body is null where there is a problem."""
    r = F.col(reply) if isinstance(reply, str) else reply
    message = F.get_json_object(r, "$.choices[0].message")
    content = F.get_json_object(message, "$.content")
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    plain = T.strip(F.coalesce(F.when(content.startswith("[") & parts.isNotNull(), joined).otherwise(content), F.lit("")))
    body = F.regexp_replace(plain, "(?i)^```(?:json)?\\s*|\\s*```$", "")
    thought = T.strip(F.coalesce(F.get_json_object(message, "$.reasoning_content"), F.lit("")))
    problem = (
        F.when(message.isNull(), "no message").when((plain == "") & (thought != ""), "only reasoning").when(plain == "", "empty")
        .when(F.get_json_object(body, "$").isNull(), "invalid").when(~T.strip(body).startswith("{"), "no object")
    )
    return F.struct(F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))


def coverage(replies: DataFrame, key: str, reply: str, candidates: DataFrame) -> DataFrame:
    """(key, valid): how many candidates (key, unit_id) a reply names a speaker for."""
    parsed = F.from_json(F.col(reply), "struct<dialogues:array<string>>")["dialogues"]
    rows = replies.select(key, F.explode(F.coalesce(parsed, F.array().cast("array<string>"))).alias("d"))
    parts = F.split("d", "\\|", 2)
    rows = rows.select(key, T.strip(F.try_element_at(parts, F.lit(1))).try_cast("int").alias("unit_id"), T.clean_speaker(F.try_element_at(parts, F.lit(2))).alias("who"))
    hit = rows.where("who <> ''").join(candidates.select(key, "unit_id").distinct(), [key, "unit_id"], "left_semi")
    return hit.groupBy(key).agg(F.countDistinct("unit_id").alias("valid"))


class Rejected(Exception):
    """A request the service does not take."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or str(status))
        self.status = status


def first_accepted(shapes: list, send: Callable):
    """The reply to the first shape of a request that is taken; only what is rejected as malformed (400, 422) is tried in another shape."""
    for k, shape in enumerate(shapes):
        try:
            return send(shape)
        except Rejected as e:
            if e.status not in (400, 422) or k == len(shapes) - 1:
                raise


def clean_name(name: object) -> str:
    """A reported name in one form; '' for what names no speaker."""
    s = " ".join(str(name or "").split()).strip(" \t\r\n.,;:!?\"'„”").split("|", 1)[0].strip()
    head, comma, tail = s.partition(",")
    if comma and "," not in tail and len(head.split()) > 1 and 1 <= len(tail.split()) <= 3:
        s = tail.strip()
    return "" if s.casefold() in P.NON_SPEAKERS else s[:120]


class Cast:
    """The people found so far in a book: stored names in order of discovery, with gender and other names."""

    def __init__(self):
        self.people: dict[str, dict] = {}

    def canonical(self, name: str, source: str) -> str:
        """The stored name a name stands for; a longer name that the text does not hold goes back to the one part of it that is known."""
        low = name.casefold()
        for p in self.people.values():
            if low == p["name"].casefold() or low in p["folded"]:
                return p["name"]
        if " " not in name or low in source.casefold():
            return name
        tokens = [t for t in name.split() if len(t) > 2]
        near = {p["name"] for p in self.people.values() if {t.casefold() for t in tokens} & {p["name"].casefold(), *p["folded"], *map(str.casefold, p["name"].split())}}
        if len(near) == 1:
            return near.pop()
        seen = [t for t in tokens if re.search(rf"\b{re.escape(t)}\b", source, re.I)]
        return seen[0] if len(seen) == 1 else name

    def add(self, name: object, gender: object = "unknown", aliases: object = None, source: str = "") -> str:
        """Takes in a reported person and gives back the stored name; the first gender that is known holds."""
        s = clean_name(name)
        if not s:
            return ""
        fixed = s.translate(str.maketrans("õÕûÛ", "őŐűŰ"))
        if fixed != s and (fixed.casefold() in source.casefold() or re.search("[őűŐŰ]", source)):
            s = fixed
        stored = self.canonical(s, source)
        p = self.people.setdefault(stored.casefold(), {"name": stored, "gender": "unknown", "aliases": set(), "folded": set()})
        g = str(gender or "unknown").strip().lower()
        if p["gender"] == "unknown" and g in GENDERS:
            p["gender"] = g
        for a in (s, *(clean_name(x) for x in (aliases if isinstance(aliases, list) else []))):
            if a and a.casefold() != p["name"].casefold():
                p["aliases"].add(a)
                p["folded"].add(a.casefold())
        return p["name"]

    def consolidate(self, count: Counter) -> dict[str, str]:
        """Short names that mean one longer name, or the dominant one, and that name; counts, genders and other names move on."""
        words = lambda x: {w.casefold() for w in re.findall(r"\w+", x)}
        moved: dict[str, str] = {}
        for short in sorted(list(self.people.values()), key=lambda p: len(p["name"])):
            own = words(short["name"])
            if short["name"] not in count or not own:
                continue
            fits = [p for p in self.people.values() if len(p["name"]) > len(short["name"]) and own <= words(p["name"])]
            fits.sort(key=lambda p: -count[p["name"]])
            if not fits or len(fits) > 1 and count[fits[0]["name"]] < max(3, 2 * count[fits[1]["name"]]):
                continue
            to = fits[0]
            to["aliases"] |= {short["name"], *short["aliases"]}
            if to["gender"] == "unknown":
                to["gender"] = short["gender"]
            count[to["name"]] += count.pop(short["name"], 0)
            moved[short["name"]] = to["name"]
            del self.people[short["name"].casefold()]
        for k in moved:
            while moved[k] in moved:
                moved[k] = moved[moved[k]]
        return moved


def _valid(parsed: dict, candidates: set[int]) -> list[tuple[int, str]]:
    out = []
    for d in parsed.get("dialogues") or []:
        m = re.match(r"^\s*(\d+)\s*\|\s*(.*?)\s*$", str(d or ""))
        if m and int(m[1]) in candidates and clean_name(m[2]):
            out.append((int(m[1]), clean_name(m[2])))
    return out


def ask(prompt: Callable[[list[str]], str], cast: Cast, candidates: set[int], call: Callable[[str], dict]) -> dict:
    """The reply to a batch; after a failure, or where it covers too little with a cast given, once more without the cast."""
    roster = [p["name"] for p in cast.people.values()][:ROSTER]
    try:
        parsed = call(prompt(roster))
    except Exception:
        return call(prompt([]))
    if roster and len({i for i, _ in _valid(parsed, candidates)}) < max(3, len(candidates) // 5):
        try:
            again = call(prompt([]))
            if len({i for i, _ in _valid(again, candidates)}) > len({i for i, _ in _valid(parsed, candidates)}):
                return again
        except Exception:
            pass
    return parsed


def analyse(units: DataFrame, chapters: DataFrame, call: Callable[[str], dict], most: int = LEAST_BATCH, keep: int = 60) -> dict[str, DataFrame]:
    """{'annotations', 'characters', 'errors'} of whole books.

    ``units`` has chapter_id, unit_index, unit_text, dialogue_candidate; ``chapters`` chapter_id, book_id, order_num, title, content. The fold runs over
    the batches of a book in order, one batch in memory at a time; what it learns at a book's end (names that were short forms) is
    joined to what it said before. The ``keep`` busiest characters stay, and the annotations of these.
    """
    from ..session import durable
    from .speakers import voices

    batch = batches(units, chapters, most)
    lines = numbered(units, batch)
    item = F.struct("request_id", "chapter_id", "unit_index", "line", "dialogue_candidate", "unit_text")
    rows = lines.groupBy("book_id", "pack_no").agg(F.sort_array(F.collect_list(item)).alias("units"))
    source = batch.join(chapters.select("chapter_id", "title", "content"), "chapter_id").groupBy("book_id", "pack_no").agg(
        _ordered("content", "\n", "order_num", "chapter_id").alias("source"), _ordered("title", ", ", "order_num", "chapter_id").alias("titles"),
    )
    rows = rows.join(source, ["book_id", "pack_no"]).select("book_id", "pack_no", "units", "source", "titles")
    kind = units.schema["chapter_id"].dataType.simpleString()
    book = chapters.schema["book_id"].dataType.simpleString()
    cols = ["book_id", "kind", "chapter_id", "unit_index", "unit_text", "name", "target", "gender", "frequency", "rank"]
    schema = f"book_id {book}, kind string, chapter_id {kind}, unit_index int, unit_text string, name string, target string, gender string, frequency int, rank int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cast, count = None, Cast(), Counter()

        def close() -> list[tuple]:
            moved = cast.consolidate(count)
            out = [(now, "moved", None, None, None, k, v, None, None, None) for k, v in moved.items()]
            for r, (name, n) in enumerate(count.most_common(max(1, keep))):
                p = cast.people.get(name.casefold(), {"gender": "unknown"})
                out.append((now, "character", None, None, None, name, None, p["gender"], n, r))
            return out

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=cols).astype({c: "Int64" for c in ("unit_index", "frequency", "rank")} | ({"chapter_id": "Int64"} if kind in ("bigint", "int") else {}))

        for b in parts:
            out = []
            for bk, _, us, text, titles in b.itertuples(index=False, name=None):
                if bk != now:
                    if now is not None:
                        out += close()
                    now, cast, count = bk, Cast(), Counter()
                by_id = {u["request_id"]: u for u in us}
                candidates = {i for i, u in by_id.items() if u["dialogue_candidate"]}
                if not candidates:
                    continue
                body = "\n".join(u["line"] for u in us)
                try:
                    parsed = ask(lambda roster: "\n".join(["CAST:", *roster, "UNITS:", body]), cast, candidates, call)
                except Exception as e:
                    out.append((bk, "error", None, None, titles, str(e), None, None, None, None))
                    continue
                about = {}
                for c in parsed.get("characters") or []:
                    if isinstance(c, dict) and (name := cast.add(c.get("name"), c.get("gender"), c.get("aliases"), text or "")):
                        about[name.casefold()] = c
                seen: set[int] = set()
                for i, raw in _valid(parsed, candidates):
                    if i in seen:
                        continue
                    meta = about.get(raw.casefold(), {})
                    name = cast.add(raw, meta.get("gender"), meta.get("aliases"), text or "")
                    seen.add(i)
                    count[name] += 1
                    u = by_id[i]
                    out.append((bk, "annotation", u["chapter_id"], u["unit_index"], u["unit_text"], name, None, None, None, None))
            yield frame(out)
        if now is not None:
            yield frame(close())

    made = durable(rows.repartition("book_id").sortWithinPartitions("book_id", "pack_no").mapInPandas(run, schema))
    moved = made.where("kind = 'moved'").select("book_id", "name", "target")
    cast = made.where("kind = 'character'").select("book_id", "name", "gender", "frequency", "rank")
    said = made.where("kind = 'annotation'").select("book_id", "chapter_id", "unit_index", "unit_text", "name").join(moved, ["book_id", "name"], "left")
    said = said.select("book_id", "chapter_id", "unit_index", "unit_text", F.coalesce("target", "name").alias("speaker_name"), F.lit(1.0).alias("confidence"), F.lit("automatic").alias("source"))
    kept = said.join(cast.select("book_id", F.col("name").alias("speaker_name")), ["book_id", "speaker_name"], "left_semi")
    errors = made.where("kind = 'error'").select("book_id", F.col("unit_text").alias("chapters"), F.col("name").alias("message"))
    return {"annotations": kept, "characters": voices(cast, "name", "gender"), "errors": errors}


def reply_json(dialogues: list[str], characters: list[dict]) -> str:
    """A reply in the agreed form."""
    return json.dumps({"dialogues": dialogues, "characters": characters}, ensure_ascii=False)
