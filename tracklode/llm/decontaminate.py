"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of 13 consecutive words (an item of fewer words is one window). To hold a window,
a document must hold all its words, so the necessary prefix of a window under the order "rarest first" is its single
rarest word. Documents are joined on that word alone; the positional bound (the window must start and end inside the
document) and the length bound come next, and an exact comparison of the words at that place verifies the rest.

Defined cases: null text has no words; an item without words or without an id is ignored; an empty benchmark hits
nothing; a null document id is an id like any other; rows that repeat give a result row each; an empty table of documents
gives an empty result; other columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

WINDOW_WORDS = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A benchmark of at most so many characters is broadcast; its windows repeat each word at most 13 times.
BROADCAST_CHARS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, case kept."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(win: the window's lower-case words joined by spaces, len, items: ids as strings), one row per distinct window."""
    w = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.lit(size), F.size("w")))
    w = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return w.groupBy(F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("win"), "len").agg(F.collect_set("item").alias("items"))


def window_hits(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW_WORDS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row (id, text_key, n_words, start 1) with null win per document, and one per verified window place.

    Columns: id, text_key (hash of the text), n_words, start (1-based word), len, win, items.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    wins = item_windows(benchmark, item_col, text_col, size)
    small = (benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0) <= broadcast_chars
    hint = F.broadcast if small else (lambda x: x)

    parts = wins.select("win", F.posexplode(F.split("win", " ")).alias("off", "word")).withColumn("key", F.lower("word"))
    vocabulary = parts.select("key").distinct()
    seen = docs.select(F.explode("w").alias("word")).select(F.lower("word").alias("key"))
    rarity = seen.join(hint(vocabulary), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A word that no document holds rules its windows out; among the others the rarest word is the window's prefix.
    ranked = parts.join(rarity, "key", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("rare"))
    prefix = ranked.where("rare.n > 0").join(wins, "win").select("win", "len", "items", F.col("rare.key").alias("key"), F.col("rare.off").alias("off"))

    at = F.col("pos") - F.col("off")
    inside = (at >= 1) & (at + F.col("len") - 1 <= F.col("n_words"))
    same = ascii_lower(F.array_join(F.slice("w", at, F.col("len")), " ")) == F.col("win")
    out = ["id", "text_key", "n_words", at.alias("start"), "len", "win", "items"]
    with_n = docs.withColumn("n_words", F.size("w").cast("long"))
    if small:  # one pass: place 0 stands for the document itself
        spread = with_n.select("id", "text_key", "n_words", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word")).withColumn("key", F.lower("word"))
        return spread.join(F.broadcast(prefix), "key", "left").where((F.col("pos") == 0) | (F.col("win").isNotNull() & inside & same)).select(*out)
    spread = with_n.select("id", "text_key", "n_words", F.posexplode("w").alias("pos0", "word")).select("id", "text_key", "n_words", (F.col("pos0") + 1).alias("pos"), F.lower("word").alias("key"))
    places = spread.join(prefix, "key").where(inside).drop("key")
    texts = docs.withColumnsRenamed({"id": "of", "text_key": "of_key"})
    found = places.join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))).where(same).select(*out)
    heads = with_n.select("id", "text_key", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("win"), F.lit(None).cast("array<string>").alias("items"))
    return heads.unionByName(found)


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW_WORDS, share: int = 20, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per document: id_col, text_key, n_words, n_hit, items (sorted ids as strings), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    hits = window_hits(documents, benchmark, id_col, text_col, item_col, size, broadcast_chars)
    place = F.when(F.col("win").isNotNull(), F.struct("start", "len"))
    # Rows that repeat are counted by their heads and given back one by one.
    per = hits.groupBy("id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("win").isNull()).cast("int").alias("rows"), F.array_sort(F.collect_set(place)).alias("places"), F.collect_set("items").alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["start"] + p["len"] - F.greatest(acc["end"], p["start"]))).cast("long").alias("n"), F.greatest(acc["end"], p["start"] + p["len"]).alias("end"))
    per = per.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select(F.col("id").alias(id_col), "text_key", "n_words", F.aggregate("places", start, step, lambda acc: acc["n"]).alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))
    return per.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of documents that are not contaminated, columns unchanged."""
    bad = contamination(documents, benchmark, id_col, text_col, **kw).where("contaminated").select(F.col(id_col).alias("_tl_id"), F.col("text_key").alias("_tl_key")).distinct()
    return without(documents, bad, F.col(id_col).eqNullSafe(F.col("_tl_id")) & (F.xxhash64(F.col(text_col)) == F.col("_tl_key")))
