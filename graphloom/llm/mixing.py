"""Mixing sources to target weights with DataFrame operations only.

Every document belongs to a block of its source (a hash range of about BLOCK_ROWS rows). A source's
target words are served in passes over its blocks, each pass in its own affine permutation, so the
draws of a source are exact positions 0, 1, 2, ... of (pass, block); only the last one is partial.
The output shards share those positions by a multivariate-hypergeometric splitting tree: each node
halves its shards and draws, source by source, how many of its block positions go left, without
replacement, by inverting the law from its mode outwards; a leaf owns disjoint runs of permuted
positions, shuffled locally by hash. A node is one row with a count for each source, so the tables
of sources must fit a row; rows and blocks of a source are never in one.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; a
source of size 0 gets target 0; an empty table gives an empty table. Rows equal in id, source and
size are taken all alike, and the one boundary block of a source takes them together or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import as_row, staged, word_count

#: Source weights by code-point order of the sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document and no source is taken more often than this.
MAX_PASSES = 3
BLOCK_ROWS = 512
#: Blocks of a source whose sizes are summed in one window.
STRETCH = 1 << 15
#: Tables with a row for each source are broadcast up to this many sources; beyond, they are joined.
FEW_SOURCES = 10_000
SEED = 20260
#: Columns that the operator adds; input columns of these names are replaced.
ADDED = {"mix_size", "mix_source_size", "mix_target", "mix_shards", "mix_shard", "mix_order"}

_K = ["__null", "__src"]


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("__null"), F.coalesce(source.cast("string"), F.lit("")).alias("__src")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Targets by water filling: min(max_passes * size, level * weight), with the level at which they use up all words.

    ``sizes`` has one row per source: __null, __src, __size. The windows below run over that table alone.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("__null", "__src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", (F.col("__size") * max_passes).cast("double")).withColumn("__full", F.col("__cap") / F.col("__w"))
    up = every.orderBy("__full", "__null", "__src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__total", F.sum("__size").over(every).cast("double"))
    s = s.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(up), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(up), F.lit(0.0))))
    # Sources fill up in the order of __full; the first that the level leaves below its cap fixes the level.
    s = s.withColumn("__fixed", F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__level"))).over(every)["__level"])
    return s.select(*_K, "__size", "__w", F.least("__cap", F.coalesce(F.col("__fixed") * F.col("__w"), F.col("__cap"))).alias("__target"))


def _blocks(n_rows: Column) -> Column:
    """A power of two, so that any odd multiplier permutes the blocks."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n_rows, F.lit(1)) / float(BLOCK_ROWS))))).cast("long")


def _permuted(block: Column, nb: Column, turn: Column, src: Column) -> Column:
    """The position of a block in pass ``turn``: an affine permutation of 0 .. nb-1."""
    a = F.pmod(F.xxhash64(src, turn, F.lit(SEED + 1)), nb).bitwiseOR(F.lit(1))
    c = F.pmod(F.xxhash64(src, turn, F.lit(SEED + 2)), nb)
    # The factors stay under 2**31 for nb up to 2**31 blocks, so the product fits a long.
    return F.pmod(block * F.pmod(a, nb) + c, nb)


def _thin(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    """(source key, __words, __id, __same): what the plan needs of the rows, counted once and written; no text is shuffled for it."""
    rows = docs.select(*_key(F.col(source)), word_count(F.col(text)).alias("__words"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__id"))
    return staged(rows.groupBy(*_K, "__id", "__words").agg(F.count("*").alias("__same")), "mixing-rows")


def plan(thin: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their blocks, targets per source, drawn blocks, boundary picks) of the mix."""
    counts = staged(thin.groupBy(*_K).agg(F.sum("__same").alias("__rows")).select(*_K, _blocks(F.col("__rows")).alias("__nb")), "mixing-sources")
    few = counts.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    blocked = thin.join(F.broadcast(counts) if few else counts, _K).withColumn("__block", F.pmod(F.xxhash64("__id", F.lit(SEED)), F.col("__nb")))
    per_block = staged(blocked.groupBy(*_K, "__nb", "__block").agg(F.sum(F.col("__words") * F.col("__same")).alias("__bsize")), "mixing-blocks")
    targets = staged(source_targets(per_block.groupBy(*_K).agg(F.sum("__bsize").alias("__size")), weights, max_passes), "mixing-targets")
    if few:
        targets = F.broadcast(targets)

    goal = F.round(F.col("__target")).cast("long")
    turns = F.when(F.col("__size") > 0, F.least(F.floor(goal / F.greatest("__size", F.lit(1))), F.lit(max_passes))).otherwise(0).cast("long")
    blocks = per_block.join(targets, _K).withColumn("__turn", turns).withColumn("__rest", goal - F.col("__turn") * F.col("__size"))
    blocks = blocks.withColumn("__at", _permuted(F.col("__block"), F.col("__nb"), F.col("__turn"), F.col("__src")))
    # running sums in two levels: over the stretches of a source, then inside each stretch
    blocks = blocks.withColumn("__stretch", F.floor(F.col("__at") / STRETCH))
    before = Window.partitionBy(*_K).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.groupBy(*_K, "__stretch").agg(F.sum("__bsize").alias("__sum")).select(*_K, "__stretch", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    run = Window.partitionBy(*_K, "__stretch").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(ahead, [*_K, "__stretch"]).withColumn("__gap", F.col("__rest") - F.col("__ahead") - F.coalesce(F.sum("__bsize").over(run), F.lit(0)))
    whole = (F.col("__gap") >= F.col("__bsize")) & (F.col("__rest") > 0)
    partial = ~whole & (F.col("__gap") > 0)
    drawn = blocks.select(*_K, "__nb", "__block", (F.col("__turn") + whole.cast("long")).alias("__times"), partial.alias("__partial"), F.when(partial, F.col("__gap")).otherwise(0).alias("__gap"))

    # The boundary block of each source: rows in hash order, each taken if it still fits.
    edge = drawn.where("__partial").select(*_K, "__block", "__gap")
    offers = blocked.where("__words > 0").join(edge, [*_K, "__block"])
    listed = offers.groupBy(*_K, "__block", "__gap").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("__id", F.lit(SEED + 3)).alias("h"), F.col("__id").alias("id"), F.col("__words").alias("w"), F.col("__same").alias("n")))).alias("__list"))

    def fit(acc: Column, x: Column) -> Column:
        fits = x["w"] * x["n"] <= acc["gap"]
        left = acc["gap"] - F.when(fits, x["w"] * x["n"]).otherwise(0)
        return F.struct(left.alias("gap"), F.when(fits, F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), x["w"].alias("w"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.col("__gap").cast("long").alias("gap"), F.from_json(F.lit("[]"), "array<struct<id:string,w:bigint>>").alias("out"))
    picks = listed.select(*_K, F.explode(F.aggregate("__list", start, fit)["out"]).alias("p")).select(*_K, F.col("p.id").alias("__id"), F.col("p.w").alias("__words"), F.lit(1).cast("long").alias("__more"))
    return blocked, targets, drawn, picks


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ln_factorials(numbers: list[tuple[Column, int]]) -> Column:
    """The sum of sign * ln n! over (n, sign), by Stirling's series eight steps further up, where it is exact to some 12 digits."""
    numbers = F.array(*[F.struct(n.cast("double").alias("n"), F.lit(float(k)).alias("k")) for n, k in numbers])

    def one(total: Column, x: Column) -> Column:
        low = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(1.0), lambda a, k: a * (x["n"] + k))
        return total + x["k"] * _let(x["n"] + 9.0, lambda z: (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(low))

    return F.aggregate(numbers, F.lit(0.0), one)


def hypergeometric(pool: Column, need: Column, own: Column, unit: Column) -> Column:
    """How many of ``need`` draws without replacement from ``pool`` positions fall on ``own`` of them, by inversion of ``unit``.

    Outcomes are tried from the mode outwards, one more and one less by turns, each by its ratio to the one before;
    13 standard deviations to either side hold everything that 53 bits of ``unit`` can tell apart.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bounded(c: Column) -> Column:
        mode = F.greatest(c["least"], F.least(c["most"], F.floor((c["need"] + 1) * ((c["own"] + 1) / (c["pool"] + 2))).cast("long")))
        share = F.greatest(c["pool"], one).cast("double")
        spread = F.sqrt(c["need"] * (c["own"] / share) * ((c["pool"] - c["own"]) / share) * ((c["pool"] - c["need"]) / F.greatest(share - 1, F.lit(1.0))))
        return _let(F.struct(c.alias("c"), mode.alias("mode"), F.least(c["most"] - c["least"], F.ceil(13 * spread).cast("long") + 16).alias("width")), searched)

    def searched(m: Column) -> Column:
        c, mode = m["c"], m["mode"]
        pool, need, own = c["pool"], c["need"], c["own"]
        top = F.exp(_ln_factorials([(own, 1), (mode, -1), (own - mode, -1), (pool - own, 1), (need - mode, -1), (pool - own - need + mode, -1), (pool, -1), (need, 1), (pool - need, 1)]))

        def step(a: Column, _: Column) -> Column:
            up = F.when(a["u"] < c["most"], a["p"] * (own - a["u"]) * ((need - a["u"]) / ((a["u"] + 1).cast("double") * (pool - own - need + a["u"] + 1)))).otherwise(F.lit(0.0))
            down = F.when(a["d"] > c["least"], a["q"] * a["d"] * ((pool - own - need + a["d"]) / ((own - a["d"] + 1).cast("double") * (need - a["d"] + 1)))).otherwise(F.lit(0.0))

            def taken(x: Column) -> Column:
                rest = a["left"] - x["up"]
                found = F.when(a["k"].isNotNull(), a["k"]).when((x["up"] > 0) & (rest <= 0), a["u"] + 1).when((x["down"] > 0) & (rest - x["down"] <= 0), a["d"] - 1)
                return F.struct((a["u"] + 1).alias("u"), x["up"].alias("p"), (a["d"] - 1).alias("d"), x["down"].alias("q"), (rest - x["down"]).alias("left"), found.alias("k"))

            return _let(F.struct(up.alias("up"), down.alias("down")), taken)

        begin = _let(top, lambda t: F.struct(mode.alias("u"), t.alias("p"), mode.alias("d"), t.alias("q"), (c["unit"] - t).alias("left"), F.when(c["unit"] <= t, mode).alias("k")))
        return F.coalesce(F.aggregate(F.sequence(zero, m["width"]), begin, step)["k"], mode)

    given = F.struct(pool.alias("pool"), need.alias("need"), own.alias("own"), unit.alias("unit"), F.greatest(zero, need + own - pool).alias("least"), F.least(need, own).alias("most"))
    return _let(given, bounded)


def shard_quotas(drawn: DataFrame, levels: int) -> DataFrame:
    """(__null, __src, __ranges): for each source, where the run of block positions of each of 2**levels shards begins.

    One row per tree node and source; a node draws the left half of its positions without replacement,
    source after source, each a hypergeometric draw given those before: the multivariate hypergeometric law.
    """
    total = drawn.groupBy(*_K).agg(F.sum("__draws").alias("n"))
    nodes = total.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("__null").alias("u"), F.col("__src").alias("s"), F.col("n").alias("n")))).alias("c")).select(F.lit(0).cast("long").alias("__shard"), "c")

    def halved(level: int):
        def step(acc: Column, x: Column) -> Column:
            u = F.xxhash64(F.lit(SEED + 9), F.lit(level), F.col("__shard"), x["u"], x["s"]).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
            hit = hypergeometric(acc["pool"], acc["need"], x["n"], u).cast("long")
            return F.struct((acc["pool"] - x["n"]).alias("pool"), (acc["need"] - hit).alias("need"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return step

    for level in range(levels):
        pool = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(pool.alias("pool"), F.floor(pool / 2).alias("need"), F.expr("cast(array() as array<bigint>)").alias("out"))
        nodes = nodes.withColumn("l", F.aggregate("c", start, halved(level))["out"])
        left = F.zip_with("c", "l", lambda x, n: F.struct(x["u"].alias("u"), x["s"].alias("s"), n.alias("n")))
        right = F.zip_with("c", "l", lambda x, n: F.struct(x["u"].alias("u"), x["s"].alias("s"), (x["n"] - n).alias("n")))
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("__shard") * 2).alias("h"), left.alias("c")), F.struct((F.col("__shard") * 2 + 1).alias("h"), right.alias("c")))).alias("x")).select(F.col("x.h").alias("__shard"), F.col("x.c").alias("c"))
    flat = nodes.select("__shard", F.explode("c").alias("x")).select("__shard", F.col("x.u").alias("__null"), F.col("x.s").alias("__src"), F.col("x.n").alias("__count"))
    before = Window.partitionBy(*_K).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = flat.withColumn("__from", F.coalesce(F.sum("__count").over(before), F.lit(0))).where("__count > 0")
    return runs.groupBy(*_K).agg(F.sort_array(F.collect_list(F.struct(F.col("__from").alias("f"), F.col("__shard").alias("h")))).alias("__ranges"))


def _sharded(drawn: DataFrame, levels: int) -> DataFrame:
    """``drawn`` with __shards: the shard of each draw of the block, in the order of the passes."""
    drawn = drawn.withColumn("__draws", F.col("__times") + F.col("__partial").cast("long"))
    turns = F.when(F.col("__draws") > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__draws"), F.lit(1)) - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))

    def shard(turn: Column) -> Column:
        at = turn * F.col("__nb") + _permuted(F.col("__block"), F.col("__nb"), turn, F.col("__src"))
        return F.element_at(F.filter("__ranges", lambda r: r["f"] <= at), -1)["h"]

    return drawn.join(shard_quotas(drawn, levels), _K, "left").withColumn("__shards", F.transform(turns, shard))


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES, shard_levels: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with mix_size, mix_source_size, mix_target and mix_shards: a shard for each copy that the mix takes.

    Everything is decided on thin rows; the documents themselves are shuffled once, by id, to meet their decision.
    """
    blocked, targets, drawn, picks = plan(_thin(docs, text, source, key), weights, max_passes)
    made = blocked.select(*_K, "__block", "__id", "__words").join(targets.select(*_K, "__size", "__target"), _K).join(_sharded(drawn, shard_levels).select(*_K, "__block", "__times", "__shards"), [*_K, "__block"])
    made = made.join(picks, [*_K, "__id", "__words"], "left")
    shards = F.slice("__shards", F.lit(1), (F.col("__times") + F.coalesce("__more", F.lit(0))).cast("int"))
    made = made.select(*_K, "__id", "__words", F.col("__size").alias("mix_source_size"), F.col("__target").alias("mix_target"), shards.alias("mix_shards"))
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ADDED]
    rows = docs.select(as_row(docs, kept), *_key(F.col(source)), word_count(F.col(text)).alias("__words"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__id"))
    out = rows.join(made, [*_K, "__id", "__words"])
    return out.select(*[F.col("__row")[c].alias(c) for c in kept], F.col("__words").alias("mix_size"), "mix_source_size", "mix_target", "mix_shards")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES, shard_levels: int = 3) -> DataFrame:
    """The mix itself: a row for every copy taken, with mix_shard and mix_order (the local shuffle of the shard)."""
    taken = copies(docs, text, source, key, weights, max_passes, shard_levels)
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    rows = taken.select(as_row(taken, kept), F.posexplode("mix_shards").alias("__turn", "mix_shard"), F.col(key).cast("string").alias("__id"))
    return rows.select(*[F.col("__row")[c].alias(c) for c in kept], "mix_shard", F.xxhash64("__id", "__turn", F.lit(SEED + 4)).alias("mix_order"))
