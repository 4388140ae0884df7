"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

A document of `size` words is taken at a rate r; rates are chosen so that every source's words meet its target, at the least
sum of r ln r - r over the documents, none above MOST. That is a convex problem whose dual has one number a source, and whose solution
is an exponential tilt of the document's size: r = min(MOST, exp(tilt * size / mean size of the source)). Newton steps on the logarithm of
the words taken, kept within a bracket, find the tilt; each step is one aggregate over how many documents of a size a source has, which is
counted once, before anything is shuffled.

Rates become whole copies in three moves. Running sums of the rates over a source's sizes, longest first, are rounded, so that the documents
of a size together have their number of copies, and the source is off its target by half its longest text at most. The rest is walked down
the sizes: of each, as many copies more or fewer as still fit into it. Within a size, copies are dealt evenly, the odd ones by a hash of
doc_id: the documents of a size are split by that hash into BUCKETS, which are counted first, so that no group of equal documents
is ordered in one task.

The walk holds a number for each different size of a source that fits into the rest, never more than its longest text has words. Sums are
decimals and whole numbers, so reruns agree to the bit.

Rows without doc_id are no documents. A null text has size 0; documents of size 0 keep rate 1 and take no words. A null source is a source, the last;
weights go by the code points of the names. A source without a word has target 0. Very long texts are counted whole. Repeated rows are each
a document; alike in all, they may get different copies, but the same together on every run. Empty tables give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import saved, stored

#: Source weights, repeating in the order of the names; the words to take, as a percent of all; the most copies of a document.
WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
#: Parts that the documents of one source and size are counted in.
BUCKETS = 4096
#: Newton steps end where every source is within this share of its target, or after so many steps.
NEAR, STEPS = 1e-9, 60

_SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (the source, sorting null last), size, mixed (a hash of doc_id), bucket: the words of each whole text."""
    source, size = F.col("source").cast("string"), F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    one = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    one = one.withColumn("key", F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b"))).withColumn("mixed", F.xxhash64("doc_id", F.lit(_SEED)))
    return one.withColumn("bucket", F.pmod("mixed", F.lit(BUCKETS)).cast("int"))


def _numbered(sources: DataFrame) -> DataFrame:
    """The rows with their number in the order of key: ranges are sorted each by itself, then counted up."""
    placed = saved(sources.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    ranges = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("within")).drop("at", "part", "within", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """key, source_size and target of each source (key, source_size): shares by weight, none above `most` times the source's
    size; what is over is dealt again by weight among the others, until nothing is."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = saved(_numbered(sources).withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size")))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full, over = 0.0, None, F.lit(False)
    while True:  # each round fills at least one source more
        filled, left, count = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if count == full or not left:
            break
        full, level = count, (percent * whole - 100 * filled) / (100 * left)
        over = F.col("weight") * F.lit(level) >= F.col("cap")
    return ranked.select("key", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _rate(most: int) -> Column:
    """The tilted rate of a document; 1 where there is nothing to tilt."""
    return F.coalesce(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))), F.lit(1.0))


def _exactly(x: Column) -> Column:
    """A sum that has the same value in any order."""
    return F.sum(x.cast("decimal(28,9)")).cast("double")


def tilts(sizes: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """key, source_size, target, mean (size), tilt: the solution of the dual. sizes: key, size, n; aims: key, source_size, target."""
    words = sizes.where("size > 0")
    spread = words.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    limit = F.log(F.lit(float(most))) * F.col("mean") / F.col("least")  # where every document is taken `most` times
    state = aims.join(spread, "key", "left").withColumn("high", limit * (1 + 1e-9)).withColumn("low", F.lit(None).cast("double"))
    state = saved(state.withColumn("tilt", F.when(F.col("target") >= (1 - 1e-12) * most * F.col("source_size"), F.col("high")).otherwise(0.0)))
    for _ in range(STEPS):
        mass = F.col("n") * F.col("size") * _rate(most)
        slope = F.when(F.col("tilt") * F.col("size") / F.col("mean") < F.log(F.lit(float(most))), mass * F.col("size") / F.col("mean")).otherwise(0.0)
        now = words.join(state.select("key", "tilt", "mean"), "key").groupBy("key").agg(_exactly(mass).alias("taken"), _exactly(slope).alias("slope"))
        now = saved(state.join(now, "key", "left"))
        if not now.where(F.abs(F.col("taken") - F.col("target")) > NEAR * F.col("target")).limit(1).count():
            break
        short = F.col("taken") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton < high) & (low.isNull() | (newton > low))
        tilt = F.when(F.col("taken").isNull() | (F.col("taken") == F.col("target")), F.col("tilt")).when(inside, newton).otherwise(F.coalesce((low + high) / 2, high - 1))
        state = now.select("key", "source_size", "target", "mean", "least", high.alias("high"), low.alias("low"), tilt.alias("tilt"))
    return state.select("key", "source_size", "target", "mean", "tilt")


def copies_of_sizes(sizes: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """key, source_size, target, size, n, rate, m: how many copies the n documents of a size get together.

    Running sums of rates over the sizes, longest first, are rounded, which leaves a source at most half its longest text off its
    target. That rest is then walked down the sizes: of each as many copies more (or fewer) as still fit into it."""
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    rows = sizes.join(solved, "key").withColumn("rate", _rate(most)).drop("mean", "tilt")
    upto = F.sum((F.col("n") * F.col("rate")).cast("decimal(28,9)")).over(down)
    rows = rows.withColumn("upto", F.round(upto).cast("long")).withColumn("m", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))).drop("upto")
    rows = saved(rows.withColumn("m", F.least(F.col("m"), most * F.col("n"))))
    rest = rows.groupBy("key").agg((F.first("target") - F.sum(F.col("m") * F.col("size"))).alias("rest"))
    room = F.when(F.col("rest") > 0, most * F.col("n") - F.col("m")).otherwise(F.col("m"))
    fits = rows.join(rest, "key").withColumn("room", room).where("size > 0 and room > 0 and size <= abs(rest)")
    walk = fits.groupBy("key").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("size", "room")), asc=False).alias("sizes"))
    start = F.expr("named_struct('rest', abs(rest), 'taken', CAST(array() AS array<struct<size:bigint, more:bigint>>))")

    def step(state: Column, at: Column) -> Column:
        more = F.least(at["room"], F.floor(state["rest"] / at["size"]))
        taken = F.when(more > 0, F.concat(state["taken"], F.array(F.struct(at["size"].alias("size"), more.alias("more"))))).otherwise(state["taken"])
        return F.struct((state["rest"] - more * at["size"]).alias("rest"), taken.alias("taken"))

    walked = walk.select("key", F.signum("rest").cast("long").alias("sign"), F.aggregate("sizes", start, step)["taken"].alias("taken")).select("key", "sign", F.inline("taken"))
    moves = walked.select("key", "size", (F.col("sign") * F.col("more")).alias("move"))
    return rows.join(moves, ["key", "size"], "left").withColumn("m", F.col("m") + F.coalesce("move", F.lit(0))).drop("move")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (words): a row a document."""
    rows = stored(sized(docs), "sizes")
    cells = saved(rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("cell")))
    sizes = saved(cells.groupBy("key", "size").agg(F.sum("cell").alias("n")))
    aims = targets(sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, percent, most)
    plan = copies_of_sizes(sizes, tilts(sizes, aims, most), most)
    before = F.sum("cell").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("cell")  # at most BUCKETS rows
    dealt = cells.withColumn("before", before).join(plan, ["key", "size"]).select(
        "key", "size", "bucket", "source_size", "target", "rate", F.floor(F.col("m") / F.col("n")).alias("each"), (F.col("m") % F.col("n") - F.col("before")).alias("odd")
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("mixed", "doc_id"))
    taken = rows.withColumn("rank", rank).join(dealt, ["key", "size", "bucket"]).withColumn("copies", F.col("each") + F.when(F.col("rank") <= F.col("odd"), 1).otherwise(0))
    return taken.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_corpus(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    names = docs.columns
    count, number, key = "__copies", "__number", ["__doc_id", "__source", "__size"]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))  # rows alike in these
    plan = mix(docs, weights, percent, most).select(F.col("doc_id").alias("__doc_id"), F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")).alias("__source"), F.col("size").alias("__size"), F.col("copies").alias(count)).withColumn(number, place)
    rows = docs.where("doc_id is not null").withColumns({"__doc_id": F.col("doc_id").cast("long"), "__source": F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")), "__size": size}).withColumn(number, place)
    return rows.join(plan.where(F.col(count) > 0), [*key, number]).withColumn(count, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*names)
