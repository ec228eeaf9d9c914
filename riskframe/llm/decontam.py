"""Benchmark decontamination by spaced-seed hashing.

Every item and every document is hashed under fixed masks that ignore selected
token positions, so a hit survives substituted words.  Items' hashes meet
documents' in an equi-join; around each hit the item is laid over the document
and the equal tokens are counted in every window that holds the hit.  The masks
are such that a window of ``WINDOW`` tokens, or a shorter item, with a fifth of
its tokens substituted has a hit in any case; an item of 4 tokens or fewer, where
a fifth is less than a token, is hashed whole.

DataFrame functions only.  Tokens are the lower-cased runs of letters and
digits; in scripts written without spaces each letter is a token.  Defined
results: an item without a token takes no part; null texts have no token;
repeated rows of either table count once, and equal texts under different ids
each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_names, key_columns, row_key

#: For windows of WINDOW tokens, and for items of LITTLE to WINDOW - 1; shorter ones have masks by their size.
MASKS = ("1101111", "11010111", "111001011")
SHORT_MASKS = ("10111", "1111")
WINDOW, LITTLE, SHORTEST, SIMILARITY = 20, 8, 1, 0.8
#: Hashes of items up to which they are broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


#: A letter of a script written without spaces; nearly all texts are decided by the first range.
UNSPACED = (r"([\x{E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\x{FF70}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
            r"\p{IsJavanese}\p{IsBalinese}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}]&&\p{L}])")


def tokens(text: Column) -> Column:
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $1 ")
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def little_masks(size: int) -> tuple[str, ...]:
    """Masks for items of ``size`` tokens, fewer than ``LITTLE``: each leaves out one of 5 tokens or more."""
    if size < 5:
        return ("1" * size,)
    return ("1" * (size - 1), *("1" * i + "0" + "1" * (size - 1 - i) for i in range(1, size - 1)))


def _seeds(words: str, at: str, masks: list[str] | tuple[str, ...], least: int) -> list[Column]:
    """Hash of the tokens that each mask keeps from position ``at``, where the mask fits."""
    out = []
    for number, mask in enumerate(masks, least):
        kept = [F.get(words, F.col(at) + i) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(F.col(at) + len(mask) <= F.col("n"), F.xxhash64(F.lit(number), *kept)))
    return out


def _positions(df: DataFrame, masks: list[str] | tuple[str, ...]) -> DataFrame:
    span = min(map(len, masks))
    return df.where(F.col("n") >= span).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - span)))


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SEEDS else df


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, window) of every document and item that share a
    window with at least ``SIMILARITY`` of its tokens equal in place."""
    b = row_key(items.select(items["item_id"].alias("doc_id"), items["text"].alias("text"))).dropDuplicates(["__k1", "__k2"])
    b = b.select(F.col("doc_id").alias("item_id"), F.col("__k1").alias("i1"), F.col("__k2").alias("i2"), tokens(F.col("text")).alias("iw"))
    b = b.withColumn("n", F.size("iw")).where(F.col("n") >= SHORTEST)

    n = F.col("n")
    # sizes of little items: at most LITTLE - 1 rows; documents are hashed under the masks of those that occur
    sizes = sorted(r["n"] for r in b.where(n < LITTLE).select("n").distinct().collect())
    kinds = [(n >= WINDOW, MASKS), ((n >= LITTLE) & (n < WINDOW), SHORT_MASKS), *((n == k, little_masks(k)) for k in sizes)]
    masks = [m for _, some in kinds for m in some]

    def of_items(part: DataFrame, own: tuple[str, ...], least: int) -> DataFrame:
        h = F.explode(F.array(*_seeds("iw", "p", own, least)))
        return _positions(part, own).select("i1", "i2", F.col("p").alias("q"), F.col("n").alias("size"), h.alias("h"))

    seeds, least = None, 0
    for which, own in kinds:
        part = of_items(b.where(which), own, least)
        seeds, least = part if seeds is None else seeds.unionByName(part), least + len(own)
    seeds = seeds.where("h is not null")
    found = seeds.count()

    d = row_key(documents(docs)).select("doc_id", "__k1", "__k2", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    each = _positions(d, masks)
    h = F.explode(F.array(*_seeds("w", "p", masks, 0)))
    if found <= BROADCAST_SEEDS:
        hits = each.select("doc_id", "__k1", "__k2", "w", "p", h.alias("h")).where("h is not null").join(F.broadcast(seeds), "h")
    else:
        # only hashes and places are shuffled by hash; a document's tokens come back to its hits
        met = each.select("__k1", "__k2", "p", h.alias("h")).where("h is not null").join(seeds, "h")
        met = met.select("__k1", "__k2", "p", "i1", "i2", "q", "size").distinct()
        hits = met.join(d.select("doc_id", "__k1", "__k2", "w").dropDuplicates(["__k1", "__k2"]), ["__k1", "__k2"])

    # the item from its first token on, laid over the document at p - q
    start = F.col("p") - F.col("q")
    hits = hits.select(
        "doc_id", "__k1", "__k2", "i1", "i2", "q", "size",
        F.slice("w", F.greatest(start, F.lit(0)) + 1, F.least("size", F.col("size") + start)).alias("dw"),
        F.greatest(-start, F.lit(0)).alias("lead"))
    hits = hits.join(_broadcast(b.select("i1", "i2", "item_id", "iw"), found), ["i1", "i2"])
    equal = F.expr("transform(iw, (x, i) -> if(get(dw, i - lead) <=> x, 1, 0))")
    width = F.least("size", F.lit(WINDOW))
    hits = hits.withColumn("equal", equal).withColumn("window", width)
    sums = F.expr("transform(sequence(greatest(q - window + 1, 0), least(q, size - window)), "
                  "j -> aggregate(slice(equal, j + 1, window), 0, (s, x) -> s + x))")
    hits = hits.withColumn("matched", F.array_max(sums)).where(F.col("matched") >= F.col("window") * SIMILARITY)
    return (hits.groupBy("__k1", "__k2", "i1", "i2")
            .agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.max("matched").alias("matched"), F.first("window").alias("window"))
            .select("doc_id", "item_id", "matched", "window", F.col("__k1").alias("k1"), F.col("__k2").alias("k2")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item; its own columns."""
    bad = overlaps(docs, items).select("k1", "k2").distinct()
    d, own = fresh_names(docs, *key_columns(docs))
    return d.join(bad, (d["v0"] == bad["k1"]) & (d["v1"] == bad["k2"]), "left_anti").select(own)
