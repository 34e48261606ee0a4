"""Line dedup with a suffix array over line-ID sequences, in DataFrame operations only.

Only lines that occur at least twice can lie in a repeated run, so every document is reduced to its segments of
consecutive repeated lines; a segment ends where a line that occurs once would break any match. Places are numbered in
the order (id, text hash, line), so a segment is a range of numbers. Prefix doubling ranks all suffixes of the segments:
level k ranks them by their first 2**k line ids, and the ranks of level k at two places 2**k apart give level k + 1.
Ranks come from a range-partitioned sort of the distinct pairs, so a line that a third of the corpus shares is one pair
there. Doubling ends when a level splits no class any more, or at the depth that the deletion needs.

The longest common prefix of neighbours in suffix order is read off the levels, longest first. Neighbours with a common
prefix of at least min_lines lines belong to one interval: a run of at least so many lines that all its suffixes begin
with. The earliest place of an interval stays, and the run is deleted at all later ones; the overlapping runs of later
places make up the maximal repeated run. Lines of at least min_chars characters are runs by themselves, from the
intervals of one common line.

Defined cases: blank lines belong to no run and stay; a null or empty text has no lines; rows with a null id pass
through and count for nothing; rows that repeat id and text share one decision; columns of documents are kept as they
are, text apart; a document of which every non-blank line goes has an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MIN_LINES = 2
MIN_CHARS = 80
#: At most so many deleted lines are broadcast to the documents; more, and runs, which most documents have, are joined by a shuffle.
BROADCAST_LINES = 500_000
KEY = ["id", "tk"]


def numbered_lines(text: Column) -> Column:
    """Array of (i: place in the text, line) of the non-blank lines."""
    all_ = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(all_, lambda x: F.trim(x["line"]) != "")


def ordered_ids(df: DataFrame, *cols: str, name: str) -> DataFrame:
    """df (distinct in cols) with dense numbers from 0 in the order of cols."""
    width = 33
    raw = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()), "order")
    raw = raw.withColumn("_p", F.shiftright("_m", width))
    sizes = raw.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")
    return raw.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_m") - F.shiftleft("_p", width)).drop("_p", "_b", "_m")


class LineSuffixes:
    """The suffix array: levels[k] has (pos, endpos, rank) by the first 2**k lines; places has what belongs to a place.

    endpos is the last place of the segment; with a depth, suffixes are told apart by at least so many lines only.
    """

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, depth: int | None = None):
        docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), numbered_lines(F.col(text_col)).alias("lines"))
        lines = docs.select("id", "tk", F.posexplode("lines").alias("ord", "l"))
        line = F.col("l.line")
        named = lines.select("id", "tk", "ord", F.col("l.i").alias("i"), F.length(line).alias("chars"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))
        repeated = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ids = cut(ordered_ids(repeated, "h1", "h2", name="rank"), "lineids")
        found = cut(named.join(ids, ["h1", "h2"]).select(*KEY, "ord", "i", "chars", "rank").dropDuplicates([*KEY, "ord"]), "found")
        placed = ordered_ids(found, *KEY, "ord", name="pos")
        own = Window.partitionBy(*KEY)
        segment = placed.withColumn("seg", F.col("ord") - F.row_number().over(own.orderBy("ord")))
        self.places = cut(segment.withColumn("endpos", F.max("pos").over(Window.partitionBy(*KEY, "seg"))).select(*KEY, "pos", "endpos", "i", "chars", "rank"), "places")
        self.levels = [self.places.select("pos", "endpos", "rank")]
        longest = self.places.agg(F.max(F.col("endpos") - F.col("pos") + 1)).first()[0] or 0
        most = longest if depth is None else min(longest, depth)
        classes = -1
        while 1 << (len(self.levels) - 1) < most:
            level, n = self.doubled()
            if n == classes:
                break
            classes = n
            self.levels.append(level)

    def doubled(self) -> tuple[DataFrame, int]:
        """The next level, rank of (rank here, rank 2**k further; -1 where the segment ends before), and its number of classes."""
        step = 1 << (len(self.levels) - 1)
        ahead = F.lead("rank", step).over(Window.partitionBy("endpos").orderBy("pos"))
        pairs = cut(self.levels[-1].withColumn("next", F.coalesce(ahead, F.lit(-1))), "pairs")
        ids = cut(ordered_ids(pairs.select("rank", "next").distinct(), "rank", "next", name="both"), "ranks")
        return cut(pairs.join(ids, ["rank", "next"]).select("pos", "endpos", F.col("both").alias("rank")), "level"), ids.count()

    def classes(self) -> DataFrame:
        """(rank, first, n, len, lcp): of each class of equal suffixes the first place, number and length, and the common prefix with the class before."""
        classes = cut(self.levels[-1].groupBy("rank").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.col("endpos") - F.col("pos") + 1).alias("len")), "classes")
        before = classes.select((F.col("rank") + 1).alias("rank"), F.col("first").alias("b"), F.col("len").alias("b_len"))
        pair = classes.join(before, "rank").select("rank", F.col("first").alias("a"), F.least("len", "b_len").alias("most"), "b", F.lit(0).cast("long").alias("lcp"))
        for k in range(len(self.levels) - 2, -1, -1):
            at = lambda side: self.levels[k].select(F.col("pos").alias(f"{side}_at"), F.col("rank").alias(f"{side}_rank"))  # noqa: B023, E731
            inside = F.col("lcp") < F.col("most")
            pair = pair.withColumn("a_at", F.when(inside, F.col("a") + F.col("lcp"))).join(at("a"), "a_at", "left").drop("a_at")
            pair = pair.withColumn("b_at", F.when(inside, F.col("b") + F.col("lcp"))).join(at("b"), "b_at", "left").drop("b_at")
            same = F.coalesce(F.col("a_rank") == F.col("b_rank"), F.lit(False))
            pair = cut(pair.select("rank", "a", "b", "most", F.when(same, F.least(F.col("lcp") + (1 << k), "most")).otherwise(F.col("lcp")).alias("lcp")), "lcp")
        return classes.join(pair.select("rank", "lcp"), "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0).cast("long")))

    def runs(self, min_lines: int) -> DataFrame:
        """(rank, lines, first, first_one): for each class the longest run it shares, and the first places of its intervals of min_lines and of one common line.

        An interval is numbered by the breaks before it, counted in blocks of ranks.
        """
        block = F.shiftright("rank", 16)
        breaks = self.classes().withColumns({"block": block, "many": (F.col("lcp") < min_lines).cast("long"), "one": (F.col("lcp") < 1).cast("long")})
        breaks = cut(breaks, "breaks")
        order = Window.partitionBy("block").orderBy("rank")
        # One row for each 65,536 classes.
        totals = breaks.groupBy("block").agg(F.sum("many").alias("m"), F.sum("one").alias("o"), F.min(F.struct("rank", "lcp")).alias("head"))
        sums = Window.orderBy("block")
        totals = totals.select("block", (F.sum("m").over(sums) - F.col("m")).alias("m"), (F.sum("o").over(sums) - F.col("o")).alias("o"), F.lead("head.lcp").over(sums).alias("behind"))
        numbered = breaks.join(F.broadcast(totals), "block")
        following = F.coalesce(F.lead("lcp").over(order), "behind", F.lit(0))
        lines = F.greatest("lcp", following, F.when(F.col("n") > 1, F.col("len")).otherwise(0))
        numbered = cut(numbered.select("rank", F.col("first").alias("p"), lines.alias("lines"), (F.sum("many").over(order) + F.col("m")).alias("many"), (F.sum("one").over(order) + F.col("o")).alias("one")), "intervals")
        first = lambda g, name: numbered.groupBy(g).agg(F.min("p").alias(name))
        return numbered.join(first("many", "first"), "many").join(first("one", "first_one"), "one").where("lines > 0").select("rank", "lines", "first", "first_one")


def repeated_lines(suffixes: LineSuffixes, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, tk, gone, longest): the places of lines of later copies, and the longest repeated run that the text takes part in."""
    runs = cut(suffixes.runs(min_lines), "runs")
    own = cut(suffixes.levels[-1].join(runs, "rank").select("pos", "lines", "first", "first_one"), "own")
    at = suffixes.places.drop("rank").join(own, "pos").repartition(*KEY)
    later = (F.col("pos") > F.col("first")) & (F.col("pos") + min_lines - 1 <= F.col("endpos"))
    way = Window.partitionBy(*KEY, "endpos").orderBy("pos").rowsBetween(1 - min_lines, 0)
    gone = F.max(later).over(way) | ((F.col("pos") > F.col("first_one")) & (F.col("chars") >= min_chars))
    return at.withColumn("gone", gone).groupBy(*KEY).agg(F.collect_list(F.when(F.col("gone"), F.col("i"))).alias("gone"), F.max("lines").alias("longest"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, with_runs: bool = False) -> DataFrame:
    """documents with the later copies deleted from text_col, and _tl_deleted (and _tl_longest with_runs): lines deleted, longest run."""
    suffixes = LineSuffixes(documents, id_col, text_col, None if with_runs else min_lines)
    per = cut(repeated_lines(suffixes, min_lines, min_chars), "repeated")
    per = per if with_runs else per.where(F.size("gone") > 0)
    few = not with_runs and (per.agg(F.sum(F.size("gone") + 1)).first()[0] or 0) <= BROADCAST_LINES
    per = per.select(F.col("id").alias("_tl_id"), F.col("tk").alias("_tl_tk"), F.col("gone").alias("_tl_gone"), F.col("longest").alias("_tl_longest"))
    out = documents.join(F.broadcast(per) if few else per, (F.col(id_col) == F.col("_tl_id")) & (F.xxhash64(F.col(text_col)) == F.col("_tl_tk")), "left")
    # A line's place is its index in the split text; what remains, the slices between deleted places, is joined as it was split.
    ends = F.concat(F.array(F.lit(-1)), F.sort_array("_tl_gone"), F.array(F.size(F.split(F.col(text_col), "\n"))))
    between = lambda z: F.flatten(F.transform(F.sequence(F.lit(1), F.size(z["ends"]) - 1), lambda j: F.slice(z["lines"], F.element_at(z["ends"], j) + 2, F.element_at(z["ends"], j + 1) - F.element_at(z["ends"], j) - 1)))
    # The text is split once: the outer lambda's variable holds its lines.
    left = F.array_join(F.transform(F.array(F.struct(F.split(F.col(text_col), "\n").alias("lines"), ends.alias("ends"))), between)[0], "\n")
    n = F.coalesce(F.size("_tl_gone"), F.lit(0))
    text = F.when(n == 0, F.col(text_col)).when(F.trim(F.translate(left, "\n", " ")) == "", F.lit("")).otherwise(left)
    out = out.withColumns({"_tl_deleted": n, "_tl_longest": F.coalesce("_tl_longest", F.lit(0)), text_col: text})
    return out.drop("_tl_id", "_tl_tk", "_tl_gone", *([] if with_runs else ["_tl_longest"]))
