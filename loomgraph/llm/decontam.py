"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask marks which of a window's token positions are hashed; the others are ignored, so that a substitution there doesn't
hide the window.  Each token becomes a 64-bit hash once; each window of a document and each window of a benchmark
item gives one key per mask; equal keys are hits.  A hit fixes a diagonal: where in the document the item would
begin.  The item's tokens are laid over the document's on that diagonal and compared position by position, and a pair is reported
if ``min_overlap`` or more of the item's tokens agree, or if ``min_tokens`` of them in a row do.

`MASKS` are sure to hit a run of ``min_tokens`` tokens.  They miss scattered substitutions, so that ``min_overlap`` has a mask of
its own, two neighbours: if at most u of an item's n tokens don't agree on a diagonal, at most u of any g pairs without a token in
common don't, so g - u of these agree.  The rarest u + 2 of the pairs (or all, if there are u + 1; counted on a sample,
which decides on the cost only) are seeds, and a diagonal with that many hits is verified.  Where an item has too few pairs for its u, single
tokens are its seeds in the same way.  Nothing at ``min_overlap`` is missed, wherever tokens differ.

One pass over the documents makes all keys.  The benchmark's seeds are rows of four numbers; they are broadcast only
if they are counted to be at most ``broadcast_keys``, and beyond that the same join shuffles, with the same results.  Only ids and
diagonals move; tokens are read again for the documents and items of diagonals that have enough hits, in
pieces of `PIECE` tokens, so neither a long document nor a long item is carried by its rows.  Documents never meet each other.

Defined cases: tokens are runs of letters and digits, lower-cased, whole texts; null and empty texts have none; items
with fewer than ``min_item_tokens`` tokens are not looked for (they are common language); an item_id with several texts is reported by the
best of them, items with one text each; a document or item that is listed twice is reported once per distinct pair
of ids; null ids take no part; extra columns are dropped; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage
from .simhash import broadcast_if

#: 1: hashed, 0: ignored.  Eight hashed positions of eleven, ends included; a run of eleven tokens hits with each.
MASKS = ("11101100111", "11011011011", "10111111001")
#: Windows that share one copy of their tokens; tokens that are compared in one row; one text in so many is counted for rarity.
STRETCH, PIECE, SAMPLE = 512, 512, 32


def tokens(text: str) -> Column:
    """64-bit hashes of the tokens of a text column."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(mask: str, number: int) -> Column:
    """The key of the window at ``q`` (from 0) of ``part``; null where the window doesn't fit."""
    hashed = ", ".join(f"get(part, q + {i})" for i, bit in enumerate(mask) if bit == "1")
    return F.expr(f"if(q + {len(mask)} <= size(part), xxhash64({number}, {hashed}), null)")


def windows(hashed: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """keep, at, number, key: one row for each place of ``h`` and each mask that fits there."""
    span = max(map(len, masks))
    stretch = hashed.filter(F.size("h") > 0).withColumn("c", F.explode(F.expr(f"sequence(0, (size(h) - 1) div {STRETCH})")))
    parts = stretch.select(*keep, "c", F.expr(f"slice(h, c * {STRETCH} + 1, {STRETCH + span - 1})").alias("part"))
    places = parts.withColumn("q", F.explode(F.expr(f"sequence(0, least({STRETCH}, size(part)) - 1)")))
    keys = places.select(*keep, (F.col("c") * STRETCH + F.col("q")).alias("at"), F.posexplode(F.array(*[_key(m, k) for k, m in enumerate(masks)])).alias("number", "key"))
    return keys.filter("key is not null")


def item_seeds(items: DataFrame, docs: DataFrame, masks: tuple[str, ...], min_overlap: float) -> DataFrame:
    """key, iv, item_at, need of items (iv, h): need is null where one hit decides for a verification, else so many hits of
    the item do.  ``masks`` end with the mask of pairs and that of single tokens."""
    pair, single = len(masks) - 2, len(masks) - 1
    n = F.size("h")
    apart = n - F.greatest(F.ceil(min_overlap * n - 1e-9), F.lit(1)).cast("int")  # tokens that needn't agree
    every = windows(items.withColumns({"n": n, "apart": apart}), masks, "iv", "n", "apart")
    use = F.when(F.expr("n div 2 > apart"), pair).otherwise(single)
    own = every.filter((F.col("number") == use) & ((F.col("number") == single) | (F.col("at") % 2 == 0)))
    some = docs.filter(f"pmod(version, {SAMPLE}) = 0").select(tokens("text").alias("h"))
    often = windows(some, masks).filter(F.col("number") >= pair).join(broadcast_if(own.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("often"))
    ranked = own.join(often, "key", "left").withColumn("rank", F.row_number().over(W.partitionBy("iv").orderBy(F.coalesce("often", F.lit(0)), "at")))
    rare = ranked.filter("rank <= apart + 2").withColumn("need", F.count("*").over(W.partitionBy("iv")) - F.col("apart"))
    runs = every.filter(F.col("number") < pair).select("key", "iv", F.col("at").alias("item_at"), F.lit(None).cast("int").alias("need"))
    return runs.unionByName(rare.select("key", "iv", F.col("at").alias("item_at"), F.col("need").cast("int").alias("need")))


def _pieces(hashed: DataFrame, *keep: str) -> DataFrame:
    """keep, c, part: ``h`` in pieces of PIECE tokens."""
    each = hashed.filter(F.size("h") > 0).withColumn("c", F.explode(F.expr(f"sequence(0, (size(h) - 1) div {PIECE})")))
    return each.select(*keep, "c", F.expr(f"slice(h, c * {PIECE} + 1, {PIECE})").alias("part"))


def agreement(diagonals: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, version, iv, start, places: the places of the item's tokens that agree on each diagonal (doc_id, version, iv, start)."""
    row = ["doc_id", "version"]
    sizes = items.select("iv", F.size("h").alias("n"))
    laid = diagonals.join(broadcast_if(sizes, name=None), "iv").withColumn("ic", F.explode(F.expr(f"sequence(0, (n - 1) div {PIECE})")))
    # a piece of the item lies over two of the document at most
    first = F.floor((F.col("start") + F.col("ic") * PIECE) / PIECE).cast("int")
    laid = laid.withColumn("c", F.explode(F.array(first, first + 1))).filter("c >= 0").select(*row, "iv", "start", "ic", "c")
    laid = laid.join(broadcast_if(_pieces(items, "iv").withColumnsRenamed({"c": "ic", "part": "own"}), 20_000, None), ["iv", "ic"])
    hit = docs.join(broadcast_if(diagonals.select(*row).distinct()), row, "left_semi").select(*row, tokens("text").alias("h"))
    met = _pieces(hit, *row).join(broadcast_if(laid, 10_000), [*row, "c"])
    shift = F.expr(f"start + ic * {PIECE} - c * {PIECE}")
    same = F.expr("filter(transform(own, (x, i) -> if(i + shift >= 0 and get(part, i + shift) = x, i, null)), i -> i is not null)")
    places = met.withColumn("shift", shift.cast("int")).select(*row, "iv", "start", "ic", "c", F.transform(same, lambda i: i + F.col("ic") * PIECE).alias("places"))
    once = places.groupBy(*row, "iv", "start", "ic", "c").agg(F.first("places").alias("places"))  # of repeated rows
    return once.groupBy(*row, "iv", "start").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, min_overlap: float = 0.6, min_tokens: int = 13, min_item_tokens: int = 6, broadcast_keys: int = 500_000) -> DataFrame:
    """doc_id, item_id, start (token of the document at which the item would begin, from 0), matched, item_tokens, overlap
    and window (agreeing tokens in the best ``min_tokens`` positions) for each pair that overlaps."""
    if any(m[0] != "1" or m[-1] != "1" or len(m) > min_tokens for m in masks):
        raise ValueError("masks must begin and end with 1 and fit in min_tokens")
    known = benchmark.filter("item_id is not null").select("item_id", tokens("text").alias("h")).filter(F.size("h") >= min_item_tokens).select("item_id", F.xxhash64("h").alias("iv"), "h")
    items = stage(known.select("iv", "h").dropDuplicates(["iv"]), "items")
    names = stage(known.select("item_id", "iv").distinct(), "item-ids")
    own = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")  # rows that share a doc_id but not the text stay apart until the end
    every = (*masks, "11", "1")
    seeds = stage(item_seeds(items, own, every, min_overlap), "seeds")

    single = seeds.filter("need is not null").join(items.select("iv", F.size("h").alias("n")), "iv").filter(f"n div 2 <= n - greatest(int(ceil({min_overlap} * n - 1e-9)), 1)")
    used = every[: -1 if single.isEmpty() else None]  # single tokens are seeds of odd thresholds or items only
    hashed = own.select("doc_id", "version", tokens("text").alias("h"))
    met = windows(hashed, used, "doc_id", "version").join(broadcast_if(seeds, broadcast_keys, None), "key")
    hits = met.groupBy("doc_id", "version", "iv", (F.col("at") - F.col("item_at")).alias("start")).agg(F.bool_or(F.col("need").isNull()).alias("run"), F.count("need").alias("n"), F.max("need").alias("need"))
    diagonals = stage(hits.filter("run or n >= need").select("doc_id", "version", "iv", "start"), "diagonals")

    laid = agreement(diagonals, own, items)
    window = F.expr(f"coalesce(array_max(transform(places, (p, i) -> aggregate(sequence(0, {min_tokens - 1}), 0, (s, j) -> if(coalesce(get(places, i + j) < p + {min_tokens}, false), s + 1, s)))), 0)")
    scored = laid.join(broadcast_if(items.select("iv", F.size("h").alias("item_tokens")), name=None), "iv").select("doc_id", "iv", "start", F.size("places").alias("matched"), "item_tokens", window.alias("window"))
    scored = scored.withColumn("overlap", F.col("matched") / F.col("item_tokens")).filter((F.col("overlap") >= min_overlap - 1e-9) | (F.col("window") >= min_tokens))
    best = F.max_by(F.struct("start", "matched", "item_tokens", "overlap", "window"), F.struct("matched", "window", -F.col("start")))
    return scored.join(broadcast_if(names, name=None), "iv").groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
