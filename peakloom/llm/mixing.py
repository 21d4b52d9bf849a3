"""Mixing sources to target weights with hash-threshold histograms.

Sizes are words. Targets share the total by weight; a target stops at MOST_REPEATS times its source's size and the
excess goes to the others by weight. A target is so many whole passes over its source and a fraction of one more.
The fraction is a threshold on a 60-bit hash of each document: words are summed by source, size class and the first
10 bits, the threshold falls into one bucket, and only that bucket is summed by the next 10 bits, and so on. Documents
are never sorted: what lies below the threshold is taken, and a larger budget takes a superset. Size classes (powers
of two) share the fraction, so that length doesn't bias the draw. At the end the one open document of each
class is taken or left, large classes first, whichever brings the source's running sum nearer to its target.

The last 20 bits of the hash come from the row's number (fixed once, in the kept table) instead of its content: only rows that are equal in every
respect that counts reach them, so that thousands of copies can be split, and reruns agree on the result.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null id
counts as a value. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import WORD_CLASS, cut, light, stored, text_of

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
LEVELS, BITS = 6, 10


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, source, size (words), class (bits of the size) and hash (60 bits) of each row; whole: and the row."""
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    base = docs.select(
        *doc,
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD_CLASS + "+")).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text_of(text_col)).alias("content"),
        F.monotonically_increasing_id().alias("row"),
    )
    return base.select(
        *[c for c in ("doc",) if whole],
        "doc_id",
        "source",
        "size",
        F.length(F.bin("size")).alias("class"),
        F.shiftleft(F.shiftrightunsigned("content", 24), 20).bitwiseOR(F.shiftrightunsigned(F.xxhash64("content", "row"), 44)).alias("hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Of a frame (source, source_size): adds weight and target. Sources in order of code points, null last, get the
    weights in turn. Sources whose limit is reached are those with the smallest limit for a weight, so the order of
    that ratio and running sums find the last of them; the windows run over one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    own = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    own = own.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    own = own.withColumns(
        {
            "left": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)),
        }
    )
    own = own.withColumn("full", most * F.col("source_size") * F.col("open") < F.col("left") * F.col("weight"))
    own = own.withColumn("first", F.min(F.when(~F.col("full"), F.col("ratio"))).over(everything))
    last = F.max(F.when(~F.col("full") & (F.col("ratio") == F.col("first")), F.struct("left", "open"))).over(everything)
    own = own.withColumn("rest", last)
    return own.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full") | (F.col("source_size") == 0), (most * F.col("source_size")).cast("double")).otherwise(F.col("rest.left") * F.col("weight") / F.col("rest.open")).alias("target"),
    )


def _prefix(level: int):
    """The hash's leading bits after so many levels."""
    return F.shiftrightunsigned("hash", BITS * (LEVELS - level))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source and class the threshold: rows with a hash below it are taken once more than whole passes say,
    and rows with this very hash (there is one, but for hash collisions) are taken if take_edge. goals: source,
    target, source_size. All tables here hold at most 2 ** BITS rows a source and class, and stay out of the driver."""
    share = F.col("target") / F.greatest("source_size", F.lit(1))
    goals = goals.select("source", (share - F.floor(share)).alias("part"))
    sums = rows.groupBy("source", "class").agg(F.sum("size").alias("words"))
    on = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.class") == F.col(f"{b}.class"))
    state = cut(
        sums.join(goals, sums["source"].eqNullSafe(goals["source"]))
        .select(sums["source"], "class", (F.col("words") * F.col("part")).alias("budget"), F.lit(0).cast("long").alias("path"))
    )
    order = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, LEVELS + 1):
        s = light(state).alias("s")
        own = rows if level == 1 else rows.alias("r").join(s, on("r", "s") & (_prefix(level - 1) == F.col("s.path"))).select("r.source", "r.class", "r.hash", "r.size")
        hist = own.groupBy("source", "class", _prefix(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("hash").alias("one"))
        h = hist.withColumn("upto", F.sum("words").over(order)).alias("h")
        edge = (
            h.join(s, on("h", "s"))
            .where(F.col("h.upto") > F.col("s.budget"))
            .groupBy("h.source", "h.class")
            .agg(F.min(F.struct("h.bucket", (F.col("s.budget") - F.col("h.upto") + F.col("h.words")).alias("budget"), "h.words", "h.n", "h.one")).alias("e"))
            .select("source", "class", F.col("e.bucket").alias("path"), "e.budget", "e.words", "e.n", "e.one")
        )
        state = cut(edge)
        if (state.agg(F.max("n")).first()[0] or 1) == 1:  # every open bucket is down to one row
            break
    return state.select("source", "class", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("path")).alias("path"), "budget", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (words, its source's), copies (how often the mix
    takes the document) and taken (words, copies times size)."""
    return mixed_rows(cut(measured(docs, id_col, text_col, source_col)), weights, most)


def mixed_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """As mix(), of measured rows that are already kept."""
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    edge = thresholds(rows, goals)
    # What each class takes for certain; then its open document, large classes first, if that brings the sum nearer.
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("all_words"))
    share = F.col("g.target") / F.greatest("g.source_size", F.lit(1))
    plan = (
        classes.alias("c")
        .join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        .join(edge.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c.class") == F.col("e.class")), "left")
        .select(
            F.col("c.source").alias("source"),
            F.col("c.class").alias("class"),
            "g.source_size",
            "g.target",
            F.floor(share).alias("passes"),
            F.coalesce("e.path", F.lit(-1)).alias("path"),
            F.coalesce("e.words", F.lit(0)).alias("edge_words"),
            F.coalesce("e.budget", F.lit(0.0)).alias("short"),
        )
    )
    grouped = plan.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "path", "edge_words", "short")), asc=False).alias("cs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("passes").alias("passes"))
    # short: how far the class is below its share without the open document; the running sum decides by rounding
    walked = F.aggregate(
        "cs",
        F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<class:int,path:bigint,edge:int>>").alias("out")),
        lambda acc, c: F.struct(
            (acc["owed"] + c["short"] - F.when((c["path"] >= 0) & (2 * (acc["owed"] + c["short"]) >= c["edge_words"]), c["edge_words"]).otherwise(F.lit(0))).cast("double").alias("owed"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        c["class"].alias("class"),
                        c["path"].alias("path"),
                        F.when((c["path"] >= 0) & (2 * (acc["owed"] + c["short"]) >= c["edge_words"]), F.lit(1)).otherwise(F.lit(0)).alias("edge"),
                    )
                ),
            ).alias("out"),
        ),
    )
    walked = grouped.withColumn("w", walked)
    plan = cut(walked.select("source", "source_size", "target", "passes", F.col("w.owed").alias("owed"), F.inline("w.out")))
    joined = rows.alias("r").join(light(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.class") == F.col("p.class")))
    extra = F.when(F.col("r.hash") < F.col("p.path"), F.lit(1)).when(F.col("r.hash") == F.col("p.path"), F.col("p.edge")).otherwise(F.lit(0))
    # Last touch: of each source one document, the one whose size is nearest to what is owed, once more or once less.
    able = F.when(F.col("p.owed") > 0, (extra == 0) & (F.col("p.passes") < most)).otherwise(extra == 1)
    off = F.abs(F.abs("p.owed") - F.col("r.size"))
    touch = (
        joined.where(able & (off < F.abs("p.owed")))
        .groupBy("p.source")
        .agg(F.min(F.struct(off.alias("off"), F.col("r.hash").alias("hash"), F.col("r.class").alias("class"), F.signum("p.owed").alias("sign"))).alias("t"))
        .select("source", "t.class", "t.hash", "t.sign")
    )
    t = light(cut(touch)).alias("t")
    on = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.class") == F.col("t.class")) & (F.col("r.hash") == F.col("t.hash"))
    copies = F.least(F.col("p.passes") + extra + F.coalesce("t.sign", F.lit(0)), F.lit(most)).cast("long")
    kept = [f"r.{c}" for c in ("doc", "doc_id", "source", "size") if c in rows.columns]
    return joined.join(t, on, "left").select(*kept, "p.source_size", "p.target", copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with their columns as they were."""
    rows = stored(measured(docs, id_col, text_col, source_col, whole=True))
    taken = mixed_rows(rows).where("taken > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
