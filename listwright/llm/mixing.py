"""Mixing sources to target weights by Pareto order sampling.

Sources are numbered by code point, null last, and weighted in turn. They share the words of all
documents by weight; a target stops at `most` times its source's words, and what is above goes to
the others by weight until none is above.

Within a source a document is wanted c x w times, at most `most`, where w is the document's own
weight and c makes the wanted words equal the target. The whole part is certain. The rest, p, is an
inclusion chance: documents are ranked by the odds of a random number divided by the odds of p, and
taken in that order until the words reach the target. The random number is a hash of the seed, the
id and the text, so reruns agree. Longer documents weigh more by default: w is the number of binary
digits of their size, so chances differ within a source.

The cut in that order is found without sorting a source: words are summed by leading bits of the
rank, and only the part in which the target is reached is looked at more closely, until it has
`boundary` documents or fewer. Those and what follows them, up to that number, are walked in order:
each that still fits is taken, and at last one that overshoots by less than what is missing. So a
source's words miss its target by less than the size of its smallest document left out there.

Bounds: one row per source passes through one task for the numbering; one array of `boundary` rows
per source is walked. Weights are positive whole numbers of which few differ, as one row is kept for
each source and weight; less than 1 counts as 1.

Defined cases: null and wordless texts have size 0 and are never taken; a null source is a source; a
null id is an id. Rows that agree in id, source and text share their copies: as many of them as the
walk takes get one more. An empty table gives no rows. Other columns are not read by `allocated`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.llm.base import fresh, written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7
BOUNDARY = 1024
#: Ranks are whole numbers of so many bits, looked at so many bits at a time.
RANK_BITS, STEP_BITS = 56, 12
_WORD = r"[^\x20\x09-\x0D]+"


def length_weight(size: Column) -> Column:
    """The number of binary digits of a size: 1 for 1, 11 for 1024."""
    return F.length(F.bin(size))


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, mark (hash of the text), size, w and m, the number of rows that agree in all."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), size.alias("size"),
                       *([weight.cast("long").alias("w")] if weight is not None else []))
    if weight is None:
        rows = rows.withColumn("w", length_weight(F.col("size")).cast("long"))
    return rows.groupBy("doc_id", "source", "mark", "size").agg(
        F.greatest(F.coalesce(F.max("w"), F.lit(1)), F.lit(1)).alias("w"), F.count(F.lit(1)).alias("m")
    )


def targets(cells: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from rows with source and words."""
    each = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = (number % len(weights)).cast("int")
    weighted = each.select(
        "source", "source_size", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = weighted.withColumn(
        "level", left / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    ).withColumn("above", F.col("level") * F.col("weight") > F.col("cap"))
    # The first source that is not above its cap sets the level of all after it.
    level = F.max(F.when(~F.col("above"), F.col("level"))).over(Window.partitionBy())
    return share.select(
        "source", "source_size",
        F.when(F.col("above"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"),
    )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def scales(cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, c and gap: what certain copies leave of the target."""
    by_weight = Window.partitionBy("own").orderBy(F.col("w").desc())
    aim = aims.select(F.col("source").alias("own"), "source_size", "target")
    joined = cells.join(aim, cells["source"].eqNullSafe(aim["own"])).filter("words > 0")
    capped = F.coalesce(F.sum("words").over(by_weight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("w")).over(by_weight.rowsBetween(0, Window.unboundedFollowing))
    tried = joined.select("own", "target", "w", "words", ((F.col("target") - most * capped) / rest).alias("try"))
    found = tried.groupBy("own").agg(
        F.max_by("try", F.when(F.col("try") * F.col("w") <= most, F.col("w"))).alias("c")
    )
    scaled = aim.alias("a").join(found.alias("f"), F.col("a.own").eqNullSafe(F.col("f.own")), "left").select(
        F.col("a.own").alias("source"), "source_size", "target", F.coalesce("c", F.lit(float(most))).alias("c")
    )
    certain = cells.join(scaled, _same(cells, scaled)).groupBy(scaled["source"].alias("own")).agg(
        F.sum(F.floor(_wanted(most)) * F.col("words")).alias("certain")
    )
    return scaled.join(certain, scaled["source"].eqNullSafe(certain["own"])).select(
        "source", "source_size", "target", "c", (F.col("target") - F.col("certain")).alias("gap")
    )


def _wanted(most: int) -> Column:
    return F.least(F.lit(float(most)), F.col("c") * F.col("w"))


def ranked(rows: DataFrame, scaled: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Rows with their source's columns, `sure` whole copies and a rank; no rank where nothing is left to chance."""
    own = scaled.withColumnRenamed("source", "own")
    joined = rows.join(own, rows["source"].eqNullSafe(own["own"])).withColumn("sure", F.floor(_wanted(most)))
    chance = _wanted(most) - F.col("sure")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 12)
    random = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = F.log(random / (1 - random)) - F.log(chance / (1 - chance))
    # Logarithms of the odds lie within 128 of 0.
    rank = F.floor((odds + 128) * float(1 << (RANK_BITS - 8))).cast("long")
    return joined.withColumn(
        "rank", F.when((chance > 0) & (F.col("size") > 0), F.least(F.greatest(rank, F.lit(0)), F.lit((1 << RANK_BITS) - 1)))
    ).drop("own", "w", "c")


def _cuts(rows: DataFrame, scaled: DataFrame, boundary: int) -> DataFrame:
    """source, gap, low and high: ranks under `low` are taken, those under `high` are walked with `gap` words left."""
    spark = rows.sparkSession
    open_ = scaled.select("source", "gap", F.lit(0).cast("long").alias("part"))
    done = None
    shift = RANK_BITS
    while True:
        shift = max(shift - STEP_BITS, 0)
        span = open_.select(F.col("source").alias("own"), F.col("gap").alias("left"), "part")
        inside = rows.filter("rank is not null").select("source", "rank", "size", "m").join(
            span, F.col("source").eqNullSafe(F.col("own"))
            & (F.shiftright("rank", min(shift + STEP_BITS, RANK_BITS)) == F.col("part"))
        )
        sums = inside.groupBy("own", "left", F.shiftright("rank", shift).alias("part")).agg(
            F.sum(F.col("size") * F.col("m")).alias("words"), F.count(F.lit(1)).alias("n")
        )
        order = Window.partitionBy("own").orderBy("part")
        upto = sums.select("own", "left", "part", "n", F.sum("words").over(order).alias("sum"), "words")
        # Where all fit, the last part is walked and nothing is lost.
        crossed = F.min(F.when(F.col("sum") > F.col("left"), F.col("part"))).over(Window.partitionBy("own"))
        last = F.max("part").over(Window.partitionBy("own"))
        after = upto.withColumn("at", F.coalesce(crossed, last)).filter("part >= at").withColumn(
            "n_upto", F.sum("n").over(order)
        )
        found = written(after.groupBy("own").agg(
            F.min(F.when(F.col("part") == F.col("at"), F.col("left") - F.col("sum") + F.col("words"))).alias("gap"),
            F.min("at").alias("part"), F.min("n_upto").alias("n"),
            F.max(F.when(F.col("n_upto") <= boundary, F.col("part"))).alias("walked"),
        ), "mix-cut")
        closed = found.filter((F.col("n") <= boundary) | F.lit(shift == 0)).select(
            F.col("own").alias("source"), "gap", F.expr(f"shiftleft(part, {shift})").alias("low"),
            F.expr(f"shiftleft(coalesce(walked, part) + 1, {shift})").alias("high"),
        )
        done = closed if done is None else done.union(closed)
        open_ = found.filter(F.col("n") > boundary).select(F.col("own").alias("source"), "gap", "part")
        if shift == 0 or open_.isEmpty():
            return done


def _walked(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows between low and high with `more`, the number of them that get one more copy."""
    cut = cuts.withColumnRenamed("source", "own").withColumnRenamed("gap", "left")
    inside = rows.join(cut, rows["source"].eqNullSafe(cut["own"])).filter("rank >= low and rank < high")
    row = F.struct("rank", "doc_id", "mark", "size", "m", "sure", "source_size", "target")
    gathered = inside.groupBy("own").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("left").alias("left"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("takes"))

    def step(state: Column, one: Column) -> Column:
        fits = F.greatest(F.lit(0), F.least(one["m"], F.floor(state["left"] / one["size"])))
        return F.struct((state["left"] - fits * one["size"]).alias("left"),
                        F.array_append(state["takes"], fits).alias("takes"))

    walked = gathered.select("own", "rows", F.aggregate("rows", start, step).alias("end"))
    missed = F.transform("rows", lambda one, i: F.when(
        (F.get(F.col("end.takes"), i) < one["m"]) & (one["size"] < 2 * F.col("end.left")),
        F.struct(one["size"].alias("size"), i.alias("i")),
    ))
    last = walked.select("own", "rows", "end.takes", F.array_min(F.array_compact(missed)).alias("last"))
    each = last.select("own", "takes", "last", F.posexplode("rows").alias("i", "row"))
    more = F.get("takes", F.col("i")) + F.when(F.col("last.i") == F.col("i"), 1).otherwise(0)
    return each.select("row.*", F.col("own").alias("source"), more.cast("long").alias("more"))


def allocated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, weight: Column | None = None, most: int = MOST,
              seed: int = SEED, boundary: int = BOUNDARY) -> DataFrame:
    """doc_id, source, mark, size, source_size, target, m and copies: how often the mix takes the m rows in all."""
    rows = written(sized(docs, weight), "mix-sizes")
    cells = written(rows.groupBy("source", "w").agg(F.sum(F.col("size") * F.col("m")).alias("words")), "mix-cells")
    scaled = written(scales(cells, targets(cells, weights, most), most), "mix-scales")
    order = written(ranked(rows, scaled, most, seed), "mix-ranks")
    cuts = written(_cuts(order, scaled, boundary), "mix-cuts")
    walked = _walked(order, cuts)
    cut = cuts.select(F.col("source").alias("own"), "low", "high")
    outside = order.join(cut, order["source"].eqNullSafe(cut["own"]), "left").filter(
        "rank is null or low is null or rank < low or rank >= high"
    ).withColumn("more", F.when(F.col("rank") < F.col("low"), F.col("m")).otherwise(0).cast("long"))
    columns = ("doc_id", "source", "mark", "size", "source_size", "target", "m")
    copies = F.when(F.col("size") > 0, F.col("sure") * F.col("m") + F.col("more")).otherwise(0).cast("long")
    return outside.select(*columns, copies.alias("copies")).union(walked.select(*columns, copies.alias("copies")))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    found = allocated(docs, **settings)
    rows = found.select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth"))
    own = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("nth") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * own).cast("long").alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    One of the rows that agree in id, source and text stands for all of them."""
    mark, whole, copies = fresh(docs, "mark", "whole", "copies")
    wanted = allocated(docs, **settings).filter("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_own"), F.col("mark").alias("_mark"), F.col("copies").alias("_n")
    )
    one = docs.groupBy("doc_id", "source", F.xxhash64("text").alias(mark)).agg(
        F.any_value(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(whole)
    )
    joined = one.join(wanted, one["doc_id"].eqNullSafe(wanted["_id"]) & one["source"].eqNullSafe(wanted["_own"])
                      & (one[mark] == wanted["_mark"]))
    return joined.select(whole, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias(copies)).select(f"{whole}.*")
