"""Greedy selection of the best rows of a group that are at least a gap apart in time.

The choice depends on order, which no window frame expresses. Two exact forms give the same rows:

* ``fold``: a group's rows in one sorted array, folded with the accepted times as state; at most k times are held.
* ``rounds``: passes that pick every row which comes first in its surroundings and drop what is too near. No group is ever gathered, so one
  group may hold any share of the rows. Each pass writes the picks so far (k a group) and the rows that are still open, so plans do not grow.

``diverse_topk`` takes the fold for groups of up to `fold_rows` rows and the rounds for larger ones; the result does not depend on it.

A row with a null time is near to nothing and nothing is near to it. A null score ranks last, and so does a null k: none is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.store import discard, materialize

#: Parts in which a group of over HOT rows meets its picks; smaller ones meet them whole.
SALTS, HOT = 64, 100_000
OUTCOMES = ("selected", "rejected_insufficient_diversity", "not_top_ranked")


def ordered(score: str, seq: str) -> Column:
    """Structs that sort by falling score, missing last, then by seq."""
    return F.struct(F.isnull(score).alias("n"), (-F.col(score)).alias("s"), F.col(seq).alias("q"))


def near(t: Column, others: Column, gap: float) -> Column:
    return F.coalesce(F.exists(others, lambda p: F.coalesce(F.abs(t - p) < gap, F.lit(False))), F.lit(False))


def fold(rows: DataFrame, keys: list[str], score: str, ts: str, seq: str, k: Column, gap: float) -> DataFrame:
    """rows with `outcome` and `pick` (1..k, null if not selected). Order: score falling, then seq."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.select(*keys, F.struct(ordered(score, seq).alias("o"), F.col(ts).cast("double").alias("t"), F.coalesce(k.cast("int"), F.lit(0)).alias("k"), F.struct(*rest).alias("row")).alias("r"))
    state = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<at:int,t:double>>").alias("picks"))
    times = lambda picks: F.transform(picks, lambda p: p["t"])

    def step(acc, r):
        free = F.size(acc["picks"]) < r["k"]
        pick = F.struct(acc["i"].alias("at"), r["t"].alias("t"))
        taken = F.when(free & ~near(r["t"], times(acc["picks"]), gap), F.concat(acc["picks"], F.array(pick))).otherwise(acc["picks"])
        return F.struct((acc["i"] + 1).alias("i"), taken.alias("picks"))

    arrays = packed.groupBy(*keys).agg(F.collect_list("r").alias("rs"))
    arrays = arrays.withColumn("rs", F.array_sort("rs"))  # the order comes first and is unique in a group
    marked = arrays.withColumn("picks", F.aggregate("rs", state, step)["picks"])
    out = marked.select(*keys, "picks", F.posexplode("rs").alias("at", "r"))
    place = F.array_position(F.transform("picks", lambda p: p["at"]), F.col("at")).cast("int")
    before = F.filter("picks", lambda p: p["at"] < F.col("at"))
    code = F.when(place > 0, place).when((F.size(before) < F.col("r.k")) & near(F.col("r.t"), times(before), gap), 0).otherwise(-1)
    return _named(out.select(*keys, "r.row.*", code.alias("_p")))


def _named(rows: DataFrame) -> DataFrame:
    p = F.col("_p")
    outcome = F.when(p > 0, OUTCOMES[0]).when(p == 0, OUTCOMES[1]).otherwise(OUTCOMES[2])
    return rows.withColumn("outcome", outcome).withColumn("pick", F.when(p > 0, p)).drop("_p")


def together(keys: list[str]) -> Column:
    """The keys as one value, in which nulls equal nulls: what joins by key use."""
    return F.struct(*keys)


def rounds(rows: DataFrame, keys: list[str], score: str, ts: str, seq: str, k: Column, gap: float, most: int | None = None, trace: list[int] | None = None) -> DataFrame:
    """The same rows as `fold`, null keys and times included, by local dominance.

    Times are hashed to cells of one gap. In each pass a row that comes before all others of its own and the two next cells is picked, as nothing that
    could keep it out is left, and what is near to a pick goes. A group that has k picks drops all rows after its k-th, which can
    no longer be chosen. So passes follow the longest chain of rows that keep each other out, and are k at most, as each picks a group's best row.
    A cell is reduced by a partial aggregate, and picks meet rows by (group, salt), so no group is ever gathered; only groups of over HOT rows have more than one salt, so picks
    have about a copy a group, and they are merged, not broadcast. `most` is an upper bound of k, if one is known; `trace` gets the rows left after each pass.
    """
    limit, least = F.coalesce(k.cast("int"), F.lit(0)), together(keys)
    t = F.col(ts).cast("double")
    # a little wider than the gap, so that rounding puts no near pair two cells apart
    cell = F.when(F.lit(gap > 0) & (F.abs(t) < float("inf")) & ~F.isnan(t), F.floor(t / F.lit(gap * 1.000001 if gap > 0 else 1.0)))
    slim = rows.select(least.alias("g"), ordered(score, seq).alias("o"), t.alias("t"), limit.alias("k"), cell.alias("c")).where("k > 0")
    # a row for every HOT rows at most
    hot = materialize(rows.groupBy(least.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g", F.lit(True).alias("hot")), "rounds-hot")
    salt = lambda o: F.when(F.col("hot"), F.pmod(F.xxhash64(o), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = materialize(slim.join(F.broadcast(hot), "g", "left").withColumn("salt", salt(F.col("o"))).drop("hot"), "rounds-rows")
    largest = left.agg(F.max("k")).first()[0] or 0
    most = largest if most is None else min(most, largest)
    # rows that are near to nothing are picks from the start
    picks = _first(left.where("c is null").select("g", "o", "t", "k"), most)
    left, held, done = left.where("c is not null"), None, []
    while most:
        best = left.groupBy("g", "c").agg(F.min("o").alias("o"))
        around = best.select("g", F.explode(F.array(*[F.col("c") + d for d in (-1, 0, 1)])).alias("c"), "o").groupBy("g", "c").agg(F.min("o").alias("least"))
        now = best.join(around.hint("merge"), ["g", "c"]).where("o = least").join(left.hint("merge"), ["g", "c", "o"]).select("g", "o", "t", "k")
        before, held = held, materialize(_first(picks.unionByName(now), most), "rounds-picks")
        picks = held
        after = left.join(_salted(held, hot).hint("merge"), ["g", "salt"], "left").where((F.coalesce(F.size("ps"), F.lit(0)) < F.col("k")) | (F.col("o") < F.element_at("ps", -1)["o"]))
        after = after.where(~near(F.col("t"), F.transform("ps", lambda p: p["t"]), gap)).select(*left.columns)
        gone, left = left, materialize(after, "rounds-rows")
        n = left.count()
        discard(*([before] if before is not None else []), gone)
        if trace is not None:
            trace.append(n)
        done = [left]
        if not n:
            break
    if held is None:
        return _named(rows.withColumn("_p", F.lit(-1)))
    o = ordered(score, seq)
    marks = hot.select(F.col("g").alias("_g"), F.col("hot").alias("_hot"))
    joined = rows.withColumns({"_k": limit, "_g": least}).join(F.broadcast(marks), "_g", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(o), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    met = _salted(held, hot).select(F.col("g").alias("_g"), F.col("salt").alias("_salt"), F.col("ps").alias("_ps"))
    joined = joined.join(met.hint("merge"), ["_g", "_salt"], "left").drop("_g", "_salt", "_hot")
    ps = F.coalesce("_ps", F.array().cast("array<" + held.select(F.struct("o", "t").alias("p")).schema["p"].dataType.simpleString() + ">"))
    place = F.array_position(F.transform(ps, lambda p: p["o"]), o).cast("int")
    before = F.filter(ps, lambda p: p["o"] < o)
    barred = near(F.col(ts).cast("double"), F.transform(before, lambda p: p["t"]), gap)
    code = F.when(place > 0, place).when((F.size(before) < F.col("_k")) & barred, 0).otherwise(-1)
    out = _named(joined.withColumn("_p", code).drop("_k", "_ps"))
    discard(*done)
    return out


def _first(picks: DataFrame, most: int) -> DataFrame:
    """The first k picks of each group."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("o"))
    return picks.withColumn("_r", place).where((F.col("_r") <= most) & (F.col("_r") <= F.col("k"))).drop("_r")


def _salted(held: DataFrame, hot: DataFrame) -> DataFrame:
    """(g, salt, ps): the picks of each group in order, once for each salt of the group."""
    found = held.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("ps")).join(F.broadcast(hot), "g", "left")  # k at most
    last = F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long")
    return found.select("g", "ps", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"))


def split(rows: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of other groups, and those of the large ones. Null keys are keys."""
    marked, found = rows.withColumn("_g", together(keys)), large.select(together(keys).alias("_g"))
    return marked.join(found, "_g", "left_anti").drop("_g"), marked.join(found, "_g", "left_semi").drop("_g")


def diverse_topk(rows: DataFrame, keys: list[str], score: str, ts: str, seq: str, k: Column | int, gap: float, fold_rows: int = 100_000) -> DataFrame:
    """rows with `outcome` and `pick`. seq breaks ties and is unique in a group; k may be a column."""
    k = k if isinstance(k, Column) else F.lit(k)
    large = rows.groupBy(*keys).count().where(F.col("count") > fold_rows)
    if large.isEmpty():
        return fold(rows, keys, score, ts, seq, k, gap)
    small, big = split(rows, keys, large)
    return fold(small, keys, score, ts, seq, k, gap).unionByName(rounds(big, keys, score, ts, seq, k, gap))
