"""Mixing sources to target weights: balanced sampling of whole documents by the cube method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import join_measured, whole
from shelfwise.operators.keys import dense_key
from shelfwise.workspace import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARE = 1.0
SEED = 11
#: Documents that one flight takes together.
BLOCK = 512
#: Documents that a flight leaves open: to the next level, or in a source's last flight to the landing, which tries all outcomes.
LANDING = 12
#: Probabilities nearer to 0 or 1 than this are settled.
SETTLED = 1e-9

WORD = r"[^\x20\x09-\x0D]+"


# --- the flight ------------------------------------------------------------------------------------


def balance(size: np.ndarray, documents: bool) -> np.ndarray:
    """Orthonormal rows that span the balancing constraints: the sizes, and the number of documents if asked for."""
    n = len(size)
    rows = []
    if documents:
        rows.append(np.full(n, n**-0.5))
        size = size - size.mean()
    norm = np.sqrt((size * size).sum())
    if norm > 1e-12:
        rows.append(size / norm)
    return np.array(rows).reshape(len(rows), n)


def fly(p: np.ndarray, size: np.ndarray, draws: Sequence[int], documents: bool = True, leave: int = 0) -> np.ndarray:
    """Move the probabilities ``p`` through the null space of the constraints until at most ``leave``, or as many as constraints, stay open.

    The sums of p * size, and of p if ``documents``, do not change. A step goes along the projection of the first open unit that can move, so that units given
    first are settled first and all others share what that costs; it ends where a probability is 0 or 1. Of the two ways along the line one is drawn
    so that every expected probability stays. ``draws`` holds a key for each unit.
    """
    p = np.where(p < SETTLED, 0.0, np.where(p > 1 - SETTLED, 1.0, p))
    live = np.flatnonzero((p > 0) & (p < 1))
    while len(live) > leave:
        rows = balance(size[live], documents)
        room = 1 - (rows * rows).sum(axis=0)
        free = np.flatnonzero(room > SETTLED)
        if len(live) <= len(rows) or not len(free):
            break
        first = free[0]
        way = -rows.T @ rows[:, first]
        way[first] += 1
        way[np.abs(way) < SETTLED * SETTLED] = 0
        own = p[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead = np.where(way > 0, (1 - own) / way, np.where(way < 0, -own / way, np.inf))
            behind = np.where(way < 0, (own - 1) / way, np.where(way > 0, own / way, np.inf))
        up, down = ahead.min(), behind.min()
        forward = uniform(draws[live[first]], len(live)) * (up + down) < down
        step = up if forward else -down
        own = own + step * way
        own[np.argmin(ahead if forward else behind)] = round(float(own[np.argmin(ahead if forward else behind)]))
        p[live] = np.where(own < SETTLED, 0.0, np.where(own > 1 - SETTLED, 1.0, own))
        live = live[(p[live] > 0) & (p[live] < 1)]
    return p


def uniform(key: int, step: int) -> float:
    """A number in [0, 1) for a unit and the number of units still open."""
    mask = (1 << 64) - 1
    value = (int(key) + step * 0x9E3779B97F4A7C15) & mask
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & mask
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & mask
    return ((value ^ (value >> 31)) >> 11) / (1 << 53)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few units that a flight leaves open: of all outcomes with the number of documents less than two off, the one nearest to the
    total of sizes, then to the number.

    A document that holds much of its source can leave the total far off. Then a unit that is taken is exchanged for one that is not, which keeps the
    number of documents; where that no longer helps, the one unit of the flight whose change comes nearest to the total is turned over, as long as it helps.
    """
    open_units = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(open_units))[:, None] >> np.arange(len(open_units))) & 1
    off = outcomes - p[open_units]
    count = np.abs(off.sum(axis=1))
    words = np.round(off @ size[open_units], 6)
    best = np.lexsort((count, np.abs(words), count >= 2))[0]
    p[open_units] = outcomes[best]
    error = _exchanged(p, size, words[best])
    while True:
        turned = error + np.where(p > 0, -size, size)
        nearest = int(np.argmin(np.abs(turned)))
        if abs(turned[nearest]) >= abs(error) - 1:
            return p
        p[nearest], error = 1 - p[nearest], turned[nearest]


def _exchanged(p: np.ndarray, size: np.ndarray, error: float) -> float:
    """What the total of sizes is off by, after exchanges of one unit with p = 1 for one with p = 0, as long as they bring it nearer."""
    while True:
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(left):
            return error
        left = left[np.argsort(size[left], kind="stable")]
        after = np.searchsorted(size[left], size[taken] - error)
        chosen = np.clip(np.concatenate([after - 1, after]), 0, len(left) - 1)
        off = error - np.tile(size[taken], 2) + size[left[chosen]]
        best = int(np.argmin(np.abs(off)))
        if abs(off[best]) >= abs(error) - 1e-6:
            return error
        p[taken[best % len(taken)]], p[left[chosen[best]]], error = 0.0, 1.0, off[best]


def _flown(table: pa.Table, block: int) -> pa.Table:
    """One group's flight: documents of middling size first, so that large and small ones stay open, which offset each other when the last
    group of a source lands."""
    size, draws = table["size"].to_numpy().astype(float), table["draw"].to_numpy()
    order = np.lexsort((draws, -size))
    rank = np.arange(len(order))
    order = order[np.argsort(-np.minimum(rank, rank[::-1]), kind="stable")]
    p = table["p"].to_numpy()[order]
    p = fly(p, size[order], draws[order], leave=min(LANDING, block // 2))
    if table["last"][0].as_py():
        p = land(p, size[order])
    out = np.empty(len(p))
    out[order] = p
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))


# --- targets ---------------------------------------------------------------------------------------


def words_in(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _key(source: str) -> Column:
    """The source as a key that is never null."""
    text = F.col(source).cast("string")
    return F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text))


def source_targets(units: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """key, source_size and target of each source of ``units`` (key, source, rows, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops at ``max_repeats`` times its source's
    size, and the excess is shared anew by weight among the others until none is above. Each round is one pass over the written
    sources; the level rises from round to round, so that a source that has stopped stays so.
    """
    sizes = units.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("rows") * F.col("size")).alias("source_size"))
    placed = dense_key(materialise(sizes, "source-sizes"), "place", [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = materialise(placed.select("key", "source_size", weight.alias("weight")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    limit = max_repeats * F.col("source_size")
    stopped, level = -1, 0.0
    while True:
        above = F.col("weight") * F.lit(level) > limit
        count, taken, open_weight = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if count <= stopped or not open_weight:
            break
        stopped, level = count, (share * total - taken) / open_weight
    target = F.when(F.col("weight") * F.lit(level) > limit, limit.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("key", "source_size", target.alias("target"))


# --- the mixture -----------------------------------------------------------------------------------


def mixture(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """How often the mix takes each document of ``docs`` (doc_id, source, text).

    One row for each distinct (doc_id, source, text): doc_id, source, th (hash of the text), rows (how many rows are equal in these), size (words of the text),
    source_size, target (of the source, in words) and copies, which counts all copies of these rows. Every row is taken as often as its source's target
    goes into its size, less the fraction; the fraction is a probability, and the cube method settles it so that the words and the documents of each source
    stay in balance. Sources are dealt into groups of about ``block`` documents. A group's flight leaves LANDING documents open at most;
    these are dealt anew, until one group of a source is left, which lands. Equal inputs and seeds give equal mixes.

    Null and empty texts have size 0. A null source is a source, a null id an id. Of repeated rows, whole copies go to all alike and one row at most is drawn. Documents of
    equal size differ only by their key. An empty table gives an empty table. Other columns play no part.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in("text").alias("size"), F.xxhash64("text").alias("th"))
    units = rows.groupBy("doc_id", "source", "th").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    units = materialise(units.withColumns({"key": _key("source"), "draw": F.xxhash64(F.lit(seed), "doc_id", "source", "th")}), "units")
    targets = source_targets(units, weights, share, max_repeats)
    planned = join_measured(units, targets, ["key"], "inner", row_bytes=96, spread=F.col("draw"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (ratio - F.floor(ratio)) * F.col("rows")
    fraction = extra - F.floor(extra)
    settled = (fraction < SETTLED) | (fraction > 1 - SETTLED)
    planned = planned.withColumns(
        {
            "copies": F.floor(ratio) * F.col("rows") + F.floor(extra) + (fraction > 1 - SETTLED).cast("long"),
            "p": F.when(settled, 0.0).otherwise(fraction),
        }
    )
    open_units = F.col("p").between(SETTLED, 1 - SETTLED)
    todo = materialise(planned, "planned")
    done = [todo.where(~open_units)]
    while True:
        todo = todo.where(open_units)
        groups = todo.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).alias("groups"))
        groups = materialise(groups, "groups")
        if groups.isEmpty():
            break
        dealt = join_measured(todo, groups, ["key"], "inner", row_bytes=64, spread=F.col("draw"))
        dealt = dealt.withColumns(
            {"group": F.pmod(F.xxhash64(F.lit(len(done)), "draw"), F.col("groups")), "last": F.col("groups") == 1}
        ).drop("groups")
        flown = materialise(dealt.groupBy("key", "group").applyInArrow(lambda table: _flown(table, block), dealt.schema), "flown").drop("group", "last")
        done.append(flown.where(~open_units))
        todo = flown
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    copies = F.col("copies") + F.round("p").cast("long")
    return result.select("doc_id", "source", "th", "rows", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as ``mixture`` takes it; equal rows stand for one another."""
    chosen = mixture(docs, **options).where(F.col("copies") > 0).select(F.struct("doc_id", "source", "th").alias("unit"), "copies")
    source = F.col("row.source").cast("string").alias("source")
    whole_rows = docs.select(F.struct("*").alias("row"))
    keyed = whole_rows.select("row", F.struct(F.col("row.doc_id").alias("doc_id"), source, F.xxhash64("row.text").alias("th")).alias("unit"))
    first = keyed.dropDuplicates(["unit"])
    joined = first.join(chosen, first["unit"].eqNullSafe(chosen["unit"])).drop("unit")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
