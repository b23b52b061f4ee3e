"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target of words; each of its documents then has the same expected number of copies, target /
source size. Whole copies are taken outright. The fractions left are rounded dependently: two documents with fractions
p, q and sizes a, b move mass between them so that a * p + b * q stays as it is and each expectation too, until
one fraction is 0 or 1. A chunk of ``CHUNK`` documents folds to one open fraction; the open fractions of all chunks
are the units of the next level, a reduction tree of about log(documents) / log(CHUNK) shuffles. So a source's words miss
its target by less than one document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, count_at_most, settle

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
#: Open fractions that are folded in one group, on average.
CHUNK = 128
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 10_000
#: Units (a source, an id and three numbers each) up to which those taken are broadcast to their documents; more are joined by a shuffle of the texts.
BROADCAST_UNITS = 400_000
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null, empty and blank texts."""
    parts = F.split(text, SPACE)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - edges, F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add the rank of each source by code point, null last, without bringing all sources to one task."""
    n = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    placed = settle(sources.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, offset, shift = F.shiftright("at", 33), 0, {}
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        shift[row["part"]], offset = offset, offset + row["count"]
    base = F.create_map([F.lit(x) for pair in shift.items() for x in pair])[part] if shift else F.lit(0)
    return placed.withColumn("rank", (base + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def source_targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size long, rank, target double) from (source, source_size).

    The targets share ``total`` times all sizes by the repeating weights; one above ``most`` times its source's size
    stops there and the excess is shared again by weight. Sources without words have target 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settle(_ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "ranked")
    want = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * total
    level = 0.0
    while True:
        free = F.col("weight") * F.lit(level) < F.col("cap")
        capped, weigh, n = ranked.agg(F.sum(F.when(~free, F.col("cap")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.count_if(free)).first()
        new = (want - (capped or 0.0)) / weigh if n else level
        if not n or new <= level * (1 + 1e-15):
            break
        level = new
    return ranked.select("source", "source_size", "rank", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _fold(units: Column) -> Column:
    """Fold an array of units (mark, id, size, p, n, whole) to a struct of ``open``, one unit, and ``done``, with up 0 or 1."""

    def closed(u: Column, up: int) -> Column:
        return F.struct(u["id"].alias("id"), u["size"].alias("size"), u["n"].alias("n"), (u["whole"] + F.lit(up)).alias("whole"))

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u["mark"].alias("mark"), u["id"].alias("id"), u["size"].alias("size"), p.alias("p"), u["n"].alias("n"), u["whole"].alias("whole"))

    def step(state: Column, unit: Column) -> Column:
        held = state["open"]
        a, b, p, q = held["size"].cast("double"), unit["size"].cast("double"), held["p"], unit["p"]
        up = F.least(1 - p, q * b / a)  # what p can gain from q
        down = F.least(p, (1 - q) * b / a)  # what it can give
        draw = F.pmod(F.xxhash64(held["mark"], unit["mark"], F.lit("pair")), F.lit(1 << 40)) / float(1 << 40)
        gains = draw * (up + down) < down
        p_full, q_empty = 1 - p <= q * b / a, p <= (1 - q) * b / a
        q_after_gain, p_after_gain = q - (1 - p) * a / b, p + q * b / a
        q_after_loss, p_after_loss = q + p * a / b, p - (1 - q) * b / a
        shut = F.when(gains, F.when(p_full, closed(held, 1)).otherwise(closed(unit, 0))).otherwise(F.when(q_empty, closed(held, 0)).otherwise(closed(unit, 1)))
        left = F.when(gains, F.when(p_full, with_p(unit, q_after_gain)).otherwise(with_p(held, p_after_gain))).otherwise(F.when(q_empty, with_p(unit, q_after_loss)).otherwise(with_p(held, p_after_loss)))
        return F.struct(left.alias("open"), F.concat(state["done"], F.array(shut)).alias("done"))

    first = F.element_at(units, 1)
    none = F.filter(F.array(closed(first, 0)), lambda _: F.lit(False))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), F.struct(first.alias("open"), none.alias("done")), step)


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, total: float, most: float, chunk: int) -> DataFrame:
    """(source, id, size, n, whole, source_size, target): whole copies in all of the n rows with this source, id and size."""
    sized = settle(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size")), "sized")
    targets = settle(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    side = F.broadcast(targets) if few else targets
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.groupBy("source", "id", "size").agg(F.count("*").alias("n")).alias("u").join(side.alias("t"), F.expr("u.source <=> t.source")).select("rank", "source_size", "target", "id", "size", "n", x.alias("x"))
    mass = F.when(F.col("size") > 0, F.col("n") * F.col("x")).otherwise(0.0)
    whole = F.floor(mass + EPS)
    units = units.withColumn("whole", whole).withColumn("p", mass - F.col("whole")).withColumn("mark", F.xxhash64("rank", "id", "size"))
    units = settle(units.drop("x"), "units")
    level = units.where(F.col("p") > EPS)
    done = [units.where(F.col("p") <= EPS).select("rank", "id", "size", "n", "whole")]
    step = 0
    while True:
        sizes = settle(level.groupBy("rank").agg(F.count("*").alias("units")), "level")
        most_units = sizes.agg(F.max("units")).first()[0] or 0
        if not most_units:
            break
        chunks = F.ceil(F.col("units") / chunk)
        own = level.join(F.broadcast(sizes) if few else sizes, "rank")
        own = own.select("rank", F.pmod(F.xxhash64("mark", F.lit(step)), chunks).alias("chunk"), F.struct(F.xxhash64("mark", F.lit(~step)).alias("order"), "mark", "id", "size", "p", "n", "whole").alias("unit"))
        groups = own.groupBy("rank", "chunk").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = settle(groups.select("rank", _fold(F.transform("units", lambda u: u.dropFields("order"))).alias("f")), "fold")
        done.append(folded.select("rank", F.explode("f.done").alias("d")).select("rank", "d.id", "d.size", "d.n", "d.whole"))
        level = folded.select("rank", "f.open.*")
        step += 1
        if most_units <= chunk:  # one open fraction for each source is left
            draw = F.pmod(F.xxhash64("mark", F.lit("last")), F.lit(1 << 40)) / float(1 << 40)
            done.append(level.select("rank", "id", "size", "n", (F.col("whole") + F.when(draw < F.col("p"), 1).otherwise(0)).alias("whole")))
            break
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    ends = targets.select("rank", "source", "source_size", "target")
    return settled.join(F.broadcast(ends) if few else ends, "rank").drop("rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """(id, size, source_size, target, copies) for each row of ``docs``.

    copies, at most ``most``, is how often the mix takes the row. Rows without words have 0 copies. Rows with the same id,
    source and size are one unit with their number: they round together and the copies are dealt among them. Null
    sources form a source, ranked last; null ids are ids. Draws depend on ids, sizes and sources alone, so reruns agree.
    An empty table gives no rows.
    """
    units = _units(docs, id_col, text_col, source_col, weights, total, most, chunk)
    each, more = F.floor(F.col("whole") / F.col("n")), F.col("whole") % F.col("n")
    rows = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (each + F.when(F.col("i") <= more, 1).otherwise(0)).cast("long").alias("copies"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, with its columns as they are.

    Of rows with the same id, source and size each is taken equally often, and what is left over falls to the smallest of them.
    """
    units = settle(_units(docs, id_col, text_col, source_col, weights, total, most, chunk), "mix").where("whole > 0")
    keys = units.select(F.col("source").alias("__s"), F.col("id").alias("__i"), F.col("size").alias("__n"), F.floor(F.col("whole") / F.col("n")).alias("__each"), (F.col("whole") % F.col("n")).alias("__more"))
    keys = F.broadcast(keys) if count_at_most(units, BROADCAST_UNITS) else keys
    own = docs.withColumn("__size", word_count(F.col(text_col)))
    met = own.join(keys, F.col(source_col).eqNullSafe(F.col("__s")) & F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__size") == F.col("__n")))
    times = lambda df, n: df.withColumn("__k", F.explode(F.expr(f"case when {n} > 0 then sequence(1L, {n}) else cast(array() as array<bigint>) end"))).select(*docs.columns)
    out = times(met, "__each")
    if units.where("whole % n > 0").isEmpty():
        return out
    left = met.where("__more > 0").groupBy("__s", "__i", "__n", "__more").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return out.unionByName(times(left.select("__row.*", "__more"), "__more"))
