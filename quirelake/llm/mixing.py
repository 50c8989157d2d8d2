"""Mixing sources to target weights (problem 9): a time-varying curriculum.

Every source has a weight schedule over training time; the schedules are scaled so that at each moment all weights add up to
one and over the whole run each source gets its target share of the tokens. Integrating a schedule gives the source's
cumulative token demand; a document that begins at some token offset of its source stands where the demand
reaches that offset (the inverse of the integral). Documents are range-sorted by that position.

Small sources are passed through again, each time in the same hash order, at most ``max_repeats`` times. With no size given the
mixture is the largest one in which every source that has documents meets its share exactly within its
repeats. Token counts come from a public tokenizer whose vocabulary file is a parameter.

Offsets come from a two-level prefix sum: documents are hashed into buckets (their number follows the number of documents), buckets are
summed and accumulated, and only inside a bucket is there a window; a source that holds a third of all
documents is thus spread over many tasks. Null and blank texts have no tokens and are not used; documents
without source or of a source that is no target are not used; a target without documents is reported with
share 0 and the other targets keep their proportions; repeated target rows count once (the largest share).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Points at which schedules are held; between them they are linear.
GRID = 256
#: Documents a bucket of the prefix sum holds on average.
PER_BUCKET = 2_000
#: The fixed splitting pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, kept columns, tokens) with the number of tokens of each text; 0 for null or blank text."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t is not None and t.strip() else 0 for t in b.iloc[:, -1]]
            yield b.iloc[:, :-1].assign(tokens=np.array(n, np.int64))

    return df.select(key, *keep, text).mapInPandas(run, kinds + ", tokens long")


def schedules(shares: dict[str, float], repeats: dict[str, int], grid: int = GRID) -> dict[str, np.ndarray]:
    """Weights at grid + 1 moments: sources that are repeated come in late, the others early.

    Alternating scaling makes the weights add up to one at each moment and each source's integral its share.
    """
    if not shares:
        return {}
    names = sorted(shares)
    t = np.linspace(0, 1, grid + 1)
    cell = np.full(grid + 1, 1 / grid)
    cell[[0, -1]] /= 2  # trapezoids
    slope = np.array([0.6 * (min(repeats.get(s) or 1, 4) - 2) / 2 for s in names])
    want = np.array([shares[s] for s in names])
    want = want / want.sum()
    w = want[:, None] * (1 + slope[:, None] * (2 * t - 1))
    for _ in range(200):
        w /= w.sum(0)
        w *= (want / (w * cell).sum(1))[:, None]
    return dict(zip(names, w))


def demand(weight: np.ndarray) -> np.ndarray:
    """The integral of a schedule up to each moment, ending at the share."""
    steps = (weight[1:] + weight[:-1]) / 2 / (len(weight) - 1)
    return np.r_[0, np.cumsum(steps)]


def plan(supply: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry for each target source: share, supply, demand; there are as many as mix_targets has rows."""
    have = {r["source"]: (r["tokens"], r["docs"]) for r in supply.join(targets.select("source").distinct(), "source").collect()}
    rows: dict[str, dict] = {}
    for r in targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).where("source is not null").orderBy("source").collect():
        tokens, docs = have.get(r["source"], (0, 0))
        rows[r["source"]] = {"source": r["source"], "target_share": float(r["share"] or 0), "max_repeats": int(r["most"] or 0), "supply": int(tokens or 0), "docs": int(docs or 0)}
    live = [x for x in rows.values() if x["supply"] and x["target_share"] > 0 and x["max_repeats"] > 0]
    whole = sum(x["target_share"] for x in live) or 1.0
    for x in rows.values():
        x["share"] = x["target_share"] / whole if x in live else 0.0
    most = min((x["supply"] * x["max_repeats"] / x["share"] for x in live), default=0.0)
    size = most if total_tokens is None else float(total_tokens)
    for x in rows.values():
        x["demand"] = min(size * x["share"], float(x["supply"] * x["max_repeats"]))
        x["size"] = size
    return list(rows.values())


def _offsets(counted: DataFrame, key: str, buckets: int, seed: int) -> DataFrame:
    """Adds the token offset of each document within its source, in hash order."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = counted.withColumn("h", h).withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return rows.join(before, ["source", "bucket"]).withColumn("offset", F.col("before") + F.col("inner")).drop("bucket", "before", "inner", "h")


def mixture(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, list[dict]]:
    """((key, source, pass_no, tokens, position) range-sorted by position, plan): the documents of the mixture, each as often as it is used."""
    rows = docs.select(key, F.col(source).alias("source"), text).where(F.col(source).isNotNull())
    rows = rows.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi")
    counted = durable(token_counts(spread(rows, key), key, text, "source", vocabulary=vocabulary).where("tokens > 0"))
    supply = durable(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    entries = plan(supply, targets, total_tokens)
    n = sum(x["docs"] for x in entries)
    offs = _offsets(counted, key, max(1, n // PER_BUCKET), seed)
    weights = schedules({x["source"]: x["share"] for x in entries if x["share"]}, {x["source"]: x["max_repeats"] for x in entries})
    curves = {s: demand(w) for s, w in weights.items()}
    of = {x["source"]: (x["supply"], x["demand"], x["share"] * x["size"]) for x in entries}
    table = docs.sparkSession.createDataFrame([(s, int(a), float(b)) for s, (a, b, _) in of.items()] or [("", 0, 0.0)], "source string, supply long, demand double")
    passes = F.ceil(F.col("demand") / F.greatest(F.col("supply"), F.lit(1))).cast("int")
    used = offs.join(F.broadcast(table), "source").where("demand > 0")
    used = used.withColumn("pass_no", F.explode(F.sequence(F.lit(1), passes)))
    at = (F.col("pass_no") - 1) * F.col("supply") + F.col("offset") + F.col("tokens") / 2
    # the document that crosses the end of the demand is used if most of it is asked for
    used = used.withColumn("at", at).where("at <= demand").select(key, "source", "pass_no", "tokens", "at")
    kind = docs.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.linspace(0, 1, GRID + 1)
        for b in batches:
            pos = np.zeros(len(b))
            for s in b["source"].unique():
                m = (b["source"] == s).to_numpy()
                pos[m] = np.interp(b["at"].to_numpy()[m] / max(of[s][2], 1.0), curves[s] / curves[s][-1], t)
            yield b.drop(columns="at").assign(position=pos)

    placed = used.mapInPandas(place, f"`{key}` {kind}, source string, pass_no int, tokens long, position double")
    return placed.orderBy("position", key, "pass_no"), entries


def shares(mixed: DataFrame, entries: list[dict]) -> DataFrame:
    """(source, target_share, share, tokens, documents, uses, most_uses, supply): the shares reached, one row for each target."""
    spark = mixed.sparkSession
    want = spark.createDataFrame([(x["source"], x["target_share"], x["supply"]) for x in entries], "source string, target_share double, supply long")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("pass_no").alias("most_uses"), F.count(F.when(F.col("pass_no") == 1, 1)).alias("documents"))
    out = want.join(got, "source", "left").fillna(0, ["tokens", "uses", "most_uses", "documents"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as there are targets
    return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0)).select("source", "target_share", "share", "tokens", "documents", "uses", "most_uses", "supply")
