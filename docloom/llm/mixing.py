"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to appear ``e`` times on average: the source's target over its size.  The whole part of
``e`` is certain.  For the rest documents are ranked by random odds over inclusion odds, and the source takes the
head of that ranking: as many words as its target still wants, to the nearest document.  The end of the head is found
by counting: the ranks' leading digits are counted per source, then the next digits within the digit where the head
ends, and so on, so no task ever sorts a source.  What is left is one bound per source, which decides each document
where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.samples import free_prefix, row_hash
from docloom.sources.tables import cut_lineage

#: Bits of a rank, and of a digit: a digit's counts are at most 2**DIGIT rows a source.
RANK, DIGIT = 60, 12
#: Documents of a source within one digit's cell that are then put in order.
CELL_ROWS = 1000
#: Sources up to which their plan is broadcast (about 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``unnamed, name, source_size, target`` from ``unnamed, name, source_size``, one row per source.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes; no target is
    above ``most`` times its source's size, the excess goes to the others by weight.
    """
    at = F.row_number().over(Window.orderBy("unnamed", "name")) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights)) + 1)).withColumn("cap", most * F.col("source_size"))
    # sources stop at their caps in this order; each stops if what the earlier ones leave would give it more
    order = Window.orderBy(F.col("cap") / F.col("w"), "unnamed", "name").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    stopped = weighed.withColumn("stops", left * F.col("w") >= F.col("cap") * weight)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(every)
    return stopped.select("unnamed", "name", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(rest * F.col("w") / open_).alias("target"))


def _rank(seed: int, name: Column, p: Column) -> Column:
    """60 bits of a document's random odds (by its key alone) over the odds of its inclusion probability ``p``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 1e-9, (q / (1 + q) * F.lit(float(1 << RANK))).cast("long"))


def _keyed(docs: DataFrame, key: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with a column ``key``: a row's id as text.  Rows that share an id, or have none, are told apart by their
    text and by a number among those of one text."""
    shared = cut_lineage(docs.groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias(f"{key}_n")).where(F.col(key).isNull() | (F.col(f"{key}_n") > 1)).select(key))
    name = F.col(id_col).cast("string")
    if shared.isEmpty():
        return docs.withColumn(key, name)
    same = docs[id_col].eqNullSafe(shared[key])
    text = F.xxhash64(text_col)
    nth = F.row_number().over(Window.partitionBy(id_col, text, source_col).orderBy(row_hash(docs)))
    alone = docs.join(shared, same, "left_anti").withColumn(key, name)
    return alone.unionByName(docs.join(shared, same, "left_semi").withColumn(key, F.concat_ws(":", F.coalesce(name, F.lit("")), text.cast("string"), nth.cast("string"))))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (words of its source) and ``copies``.

    A source is a value of ``source_col``, null included.  Copies are 0 to ``most``; a source's taken words differ
    from its target by about half a document at most.  Rows that repeat an id, or have none, are decided one by one,
    equal rows too.  A null or empty text has size 0 and no copy beyond the certain ones.  Equal inputs give equal
    results, whatever the partitions.  An empty table gives an empty result.  A column of ``docs`` with the name of a new one is replaced.
    """
    given = docs.columns
    p = free_prefix(given)
    docs = _keyed(docs, f"{p}id", id_col, text_col, source_col)
    base = docs.select(F.col(f"{p}id").alias("id"), F.col(source_col).isNull().alias("unnamed"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), word_count(F.col(text_col)).alias("size"))
    narrow = cut_lineage(base)
    sizes = narrow.groupBy("unnamed", "name").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a whole number but for rounding is a whole number
    plan = plan.withColumn("whole", F.floor(each + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), each - F.col("whole")))
    plan = cut_lineage(plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    wide = plan.limit(BROADCAST_SOURCES + 1).count() > BROADCAST_SOURCES
    small = (lambda df: df) if wide else F.broadcast
    key = ["unnamed", "name"]
    ranked = narrow.where("size > 0").join(small(plan.where("p > 1e-9").select(*key, "p")), key).select(*key, "id", "size", _rank(seed, F.col("id"), F.col("p")).alias("z"))
    cells = plan.where("p > 1e-9").select(*key, F.col("wanted"), F.lit(0).cast("long").alias("low"))
    shift, inside = RANK, ranked
    while shift > 0:
        shift -= DIGIT
        digits = inside.join(small(cells), key).where(F.shiftright("z", shift + DIGIT) == F.col("low"))
        counts = digits.groupBy(*key, "wanted", F.shiftright("z", shift).alias("low")).agg(F.sum("size").alias("held"), F.count("*").alias("rows"))
        upto = F.sum("held").over(Window.partitionBy(*key).orderBy("low"))
        ends = counts.withColumn("upto", upto).where("upto >= wanted").groupBy(*key).agg(F.min(F.struct("low", "upto", "held", "wanted", "rows")).alias("e"))
        found = cut_lineage(ends.select(*key, (F.col("e.wanted") - F.col("e.upto") + F.col("e.held")).alias("wanted"), F.col("e.low").alias("low"), F.col("e.rows").alias("rows")))
        cells = found.drop("rows")
        largest = found.agg(F.max("rows")).first()[0]
        if largest is None or largest <= CELL_ROWS:
            break
    order = Window.partitionBy(*key).orderBy("z", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        inside.join(small(cells), key).where(F.shiftright("z", shift) == F.col("low")).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        # to the nearest: a document goes with the head if it takes the sum nearer to what is wanted
        .where("before < wanted and (before + size <= wanted or before + size - wanted <= wanted - before)")
        .groupBy(*key).agg(F.max(F.struct("z", F.col("id").alias("last_id"))).alias("m"))
        .select(*key, F.col("m.z").alias("z_last"), F.col("m.last_id").alias("last_id"))
    )
    bounds = plan.join(cells.select(*key, "low"), key, "left").join(last, key, "left")
    # a source whose documents together don't reach what is wanted (it stops short by rounding) takes them all
    bounds = bounds.withColumn("open", (F.col("p") > 1e-9) & F.col("low").isNull()).withColumn("z_low", F.shiftleft(F.col("low"), shift))
    bounds = cut_lineage(bounds.select(*key, "source_size", "target", "whole", "p", "open", "z_low", "z_last", "last_id"))
    new = {"size": word_count(F.col(text_col)), f"{p}unnamed": F.col(source_col).isNull(), f"{p}name": F.coalesce(F.col(source_col).cast("string"), F.lit(""))}
    of = {c: F.col(f"{p}b_{c}") for c in bounds.columns}
    bound = bounds.select(*[F.col(c).alias(f"{p}b_{c}") for c in bounds.columns])
    joined = docs.drop("source_size", "target", "copies").withColumns(new).join(small(bound), (F.col(f"{p}unnamed") == of["unnamed"]) & (F.col(f"{p}name") == of["name"]))
    z = _rank(seed, F.col(f"{p}id"), of["p"])
    head = of["open"] | (z < of["z_low"]) | (z < of["z_last"]) | ((z == of["z_last"]) & (F.col(f"{p}id") <= of["last_id"]))
    copies = of["whole"] + F.when((F.col("size") > 0) & F.coalesce(head, F.lit(False)), 1).otherwise(0)
    return joined.withColumns({"source_size": of["source_size"], "target": of["target"], "copies": copies.cast("int")}).select(
        *[c for c in given if c not in ("size", "source_size", "target", "copies")], "size", "source_size", "target", "copies"
    )


def take_copies(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as its copies say."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
