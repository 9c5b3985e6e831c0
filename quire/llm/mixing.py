"""Mixing sources to target shares, sized in tokens.

Weights go down a tree (source, then domain, then language); a node that cannot
use its budget hands the shortage to its siblings before it goes up. Each leaf
then repeats its texts in epochs: whole epochs first, and of the last epoch the
prefix, in an order seeded per epoch, that fills the budget to the token.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.truncation import source_name
from quire.operators.ranking import running_totals
from quire.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the ranks of the default tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The levels of the tree: the given shares are those of the first, below it a node weighs as much as its tokens unless a weight is given.
LEVELS = ("source", "doc_type", "lang")
#: Leaves and targets are configuration-sized (sources x domains x languages); more are refused, not cut.
MAX_LEAVES = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a ranks file, once per Python worker; the copy that was shipped to the worker where there is one."""
    import tiktoken

    shipped = SparkFiles.get(os.path.basename(path))
    with open(shipped if os.path.exists(shipped) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, path: str | None = TOKENIZER, keep: tuple[str, ...] = ("doc_id", *LEVELS)) -> DataFrame:
    """The kept columns, a 128-bit key of the text, and n_tokens (chars where ``path`` is None); texts leave the plan here.

    The driver's tokenizer file goes to the workers with the job.
    """
    d = docs.where(F.col("text").isNotNull()).select(*keep, F.unhex(F.md5("text")).alias("text_key"), "text")
    if path is None:
        return d.withColumn("n_tokens", F.length("text").cast("long")).drop("text")
    docs.sparkSession.sparkContext.addFile(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(n_tokens=n)

    return d.mapInPandas(count, d.drop("text").schema.add("n_tokens", "long"))


Path = tuple[str, ...]


def budgets(leaves: list[tuple[Path, int, int]], weights: dict[Path, float], total: int | None = None) -> tuple[int, dict[Path, int]]:
    """(total, budget of each leaf) for leaves (path, tokens, repeats) of a tree of any depth.

    ``weights``: of nodes by path. The first level's are the target shares, and
    nodes without one there get nothing; below, a node without one weighs its
    tokens. No leaf gets more than tokens x repeats, so no node more than the
    sum of its leaves; what a node cannot use goes to its siblings by their
    weights. Without ``total`` it is the largest at which every node of the
    first level that has tokens reaches its share.
    """
    most: dict[Path, int] = {}
    tokens: dict[Path, int] = {}
    children: dict[Path, set[Path]] = {}
    for path, t, r in leaves:
        for i in range(1, len(path) + 1):
            node = path[:i]
            most[node], tokens[node] = most.get(node, 0) + t * r, tokens.get(node, 0) + t
            children.setdefault(path[: i - 1], set()).add(node)
    top = {n: weights[n] for n in children.get((), ()) if weights.get(n, 0) > 0 and most[n] > 0}
    if not top:
        return 0, {}
    scale = sum(top.values())
    if total is None:
        total = int(min(most[n] * scale / w for n, w in top.items()))
    given = _fill(total, {n: w / scale for n, w in top.items()}, most)
    out: dict[Path, int] = {}
    while given:
        below: dict[Path, int] = {}
        for node, b in given.items():
            kids = {n: weights.get(n, float(tokens[n])) for n in children.get(node, ()) if most[n] > 0}
            kids = {n: w for n, w in kids.items() if w > 0}
            if kids:
                below.update(_fill(b, kids, most))
            else:
                out[node] = b
        given = below
    return total, out


def _fill(total: int, weights: dict[Path, float], most: dict[Path, int]) -> dict[Path, int]:
    """Split ``total`` by weight under the caps; whole numbers that add up as far as the caps allow."""
    left, open_, got = float(total), dict(weights), {}
    while open_:
        w = sum(open_.values())
        full = {k for k in open_ if left * open_[k] / w >= most[k]}
        if not full:
            got.update({k: left * x / w for k, x in open_.items()})
            break
        for k in full:
            got[k] = float(most[k])
            del open_[k]
        left = max(0.0, total - sum(got.values()))
    out = {k: int(v) for k, v in got.items()}
    rest = min(total, sum(most[k] for k in out)) - sum(out.values())
    for k in sorted(out, key=lambda k: (out[k] - got[k], k)):
        add = min(rest, 1, most[k] - out[k])
        out[k] += add
        rest -= add
    return out


def _listed(rows: DataFrame) -> list:
    """The rows of a configuration-sized frame; more than MAX_LEAVES are refused."""
    got = rows.limit(MAX_LEAVES + 1).collect()
    if len(got) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} sources or leaves")
    return got


def _targets(targets: DataFrame) -> list:
    return _listed(targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")))


def distinct_texts(docs: DataFrame, targets: DataFrame, path: str | None = TOKENIZER) -> DataFrame:
    """One row per different text of the listed sources: its least doc_id with that row's source, domain and language."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(source_name(F.col("source")).alias("source")).distinct()
    for c in LEVELS[1:]:
        if c not in docs.columns:  # a level the documents don't know
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    d = docs.withColumn("source", source_name(F.col("source"))).join(F.broadcast(wanted), "source", "left_semi")  # at most MAX_LEAVES, as _targets sees to
    t = sized(d, path).where("n_tokens > 0")
    levels = [F.coalesce(c, F.lit("und")).alias(c) for c in LEVELS[1:]]
    one = t.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", *levels, "n_tokens")).alias("r"))
    return one.select("text_key", "r.*")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, path: str | None = TOKENIZER, stretch: float = 1.0) -> DataFrame:
    """doc_id, source, doc_type, lang, epoch, n_tokens, tokens_used: the mix, a row for each time a text is used.

    A text that several documents hold counts as one text, of the document with
    the least id. Only the last text of a leaf may be used in part. Documents
    with a null source or text, and sources that are not listed, are not used;
    no listed source with tokens gives an empty mix. Repeats that are null count
    as 1. Without ``total`` it is ``stretch`` times the largest at which all
    shares are reached; beyond 1, small sources run out and others take over.
    """
    wanted = _targets(targets)
    texts = cut_lineage(distinct_texts(docs, targets, path))
    repeats = {r["source"]: max(1, r["repeats"] or 1) for r in wanted}
    leaves = [(tuple(r[c] for c in LEVELS), r["t"], repeats[r["source"]]) for r in _listed(texts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t")))]
    weights = {(r["source"],): r["share"] for r in wanted}
    reached, given = budgets(leaves, weights, total)
    if total is None and stretch != 1.0:
        _, given = budgets(leaves, weights, int(reached * stretch))
    size = {p: t for p, t, _ in leaves}
    plan = [(*p, b // size[p], b % size[p]) for p, b in given.items()]
    plan_df = docs.sparkSession.createDataFrame(plan, ", ".join(f"{c} string" for c in LEVELS) + ", whole long, rest long")
    placed = texts.join(F.broadcast(plan_df), list(LEVELS))  # at most MAX_LEAVES rows
    order = F.xxhash64(F.lit(seed), F.col("whole"), "text_key")
    run = running_totals(placed.withColumn("_order", order), list(LEVELS), ["_order", "doc_id"], "n_tokens", "_to", "_from")
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("_from")))
    none = F.expr("cast(array() as array<struct<epoch:int,tokens_used:bigint>>)")
    whole = F.expr("transform(sequence(0, whole - 1), e -> struct(cast(e as int) as epoch, n_tokens as tokens_used))")
    used = F.concat(F.when(F.col("whole") > 0, whole).otherwise(none), F.when(part > 0, F.array(F.struct(F.col("whole").cast("int").alias("epoch"), part.alias("tokens_used")))).otherwise(none))
    return run.select("doc_id", *LEVELS, "n_tokens", F.explode(used).alias("u")).select("doc_id", *LEVELS, "u.epoch", "n_tokens", "u.tokens_used")


def mix_shares(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, path: str | None = TOKENIZER, stretch: float = 1.0) -> DataFrame:
    """source, target_share, tokens, actual_share, n_texts, most_uses, max_repeats for every listed source."""
    m = cut_lineage(mix(docs, targets, total, seed, path, stretch))
    per = m.groupBy("source").agg(F.sum("tokens_used").alias("tokens"), F.count_distinct("doc_id").alias("n_texts"), F.max(F.col("epoch") + 1).alias("most_uses"))
    all_ = m.agg(F.sum("tokens_used").alias("all_tokens"))  # one row
    t = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
    j = t.join(per, "source", "left").crossJoin(F.broadcast(all_)).na.fill(0, ["tokens", "n_texts", "most_uses"])
    return j.select("source", F.round("target_share", 6).alias("target_share"), "tokens", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("actual_share"), "n_texts", "most_uses", "max_repeats")
