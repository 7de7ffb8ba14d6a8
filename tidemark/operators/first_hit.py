"""The first bar that ends a trade, found over a stored tree of block extremes.

A block holds ``FAN`` bars, the block above it ``FAN`` such blocks, and so on. A tree row has the
extremes of its children: highest high, lowest low, and the deepest fall and rise inside each,
which tell exactly whether a trailing stop is touched there. A candidate looks at what is left of its own block;
finds it nothing, it goes one level up and skips whole blocks, and where one has a hit it goes down again. So it meets
one tree row in each step, and its steps grow with the logarithm of the time it is open.

Prices come signed: a short is a long of negated prices, whose falls are the rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

FAN = 64
#: Slack of the test on blocks, whose falls are differences; bars decide exactly.
SLACK = 1e-9
#: Steps between two checkpoints.
STEPS = 2


def _node(i: Column, high: Column, low: Column, up: Column, down: Column, fall: Column, rise: Column, open_: Column, at: Column) -> Column:
    named = {"i": i.cast("long"), "high": high, "low": low, "up": up, "down": down, "fall": fall, "rise": rise, "open": open_, "timestamp": at}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def _summed(children: str, i: Column, at_type: str) -> Column:
    """One node for a row's children, in their order."""
    inf = float("inf")
    start = F.struct(F.lit(-inf).alias("up"), F.lit(inf).alias("down"), F.lit(-inf).alias("fall"), F.lit(-inf).alias("rise"))
    merge = lambda acc, x: F.struct(
        F.greatest(acc["up"], x["up"]).alias("up"),
        F.least(acc["down"], x["down"]).alias("down"),
        F.greatest(acc["fall"], x["fall"], acc["up"] - x["low"]).alias("fall"),
        F.greatest(acc["rise"], x["rise"], x["high"] - acc["down"]).alias("rise"),
    )
    whole = F.aggregate(children, start, merge)
    top = F.array_max(F.transform(children, lambda x: x["high"]))
    bottom = F.array_min(F.transform(children, lambda x: x["low"]))
    return _node(i, top, bottom, whole["up"], whole["down"], whole["fall"], whole["rise"], F.lit(None).cast("double"), F.lit(None).cast(at_type))


def extremes(bars: DataFrame, series: tuple[str, ...] = ("symbol",), up: Column | None = None, down: Column | None = None) -> tuple[DataFrame, int]:
    """(series, level, parent, children) of dense ``bar_idx`` from 0 on, checkpointed; and the highest level.

    ``up`` and ``down`` are what a trailing stop of a long and of a short follows: the high and the low unless given.
    """
    up, down = (F.col("high") if up is None else up).cast("double"), (F.col("low") if down is None else down).cast("double")
    high, low = F.col("high").cast("double"), F.col("low").cast("double")
    bar = _node(F.col("bar_idx"), high, low, up, down, up - low, high - down, F.col("open").cast("double"), F.col("timestamp"))
    at_type = bars.schema["timestamp"].dataType.simpleString()
    packed = lambda df, level: df.groupBy(*series, F.lit(level).alias("level"), F.floor(F.col("x.i") / FAN).alias("parent")).agg(F.array_sort(F.collect_list("x")).alias("children"))
    now = cut(packed(bars.select(*series, bar.alias("x")), 0))
    tree, level = now, 0
    while (now.agg(F.max("parent")).collect()[0][0] or 0) > 0:
        level += 1
        now = cut(packed(now.select(*series, _summed("children", F.col("parent"), at_type).alias("x")), level))
        tree = tree.unionByName(now)
    return tree, level


def _scan(state: DataFrame) -> Column:
    """best, and of the first child that is touched: at, open, fav, adv, timestamp; ``at`` is null where none is."""
    long, leaf = F.col("sign") > 0, F.col("level") == 0
    side = lambda c, a, b: F.when(long, c[a]).otherwise(-c[b])
    fav, adv, moved = (lambda c: side(c, "high", "low")), (lambda c: side(c, "low", "high")), (lambda c: side(c, "up", "down"))

    def touched(best: Column, c: Column) -> Column:
        after = F.greatest(best, moved(c))
        drop = F.greatest(best - adv(c), F.when(long, c["fall"]).otherwise(c["rise"]))
        near = drop >= F.col("s_dist") - SLACK * (F.abs(F.col("s_dist")) + F.abs(after) + F.abs(adv(c)))
        stop = F.when(~F.col("active"), moved(c) >= F.col("s_act")).when(leaf, adv(c) <= after - F.col("s_dist")).otherwise(near)
        return (adv(c) <= F.col("s_sl")) | (fav(c) >= F.col("s_tp")) | (F.col("trailing") & stop)

    at_type = next(f.dataType.simpleString() for f in state.schema["children"].dataType.elementType if f.name == "timestamp")
    null = lambda kind: F.lit(None).cast(kind)
    found = lambda best, at, o, f, a, m, t: F.struct(best.alias("best"), at.alias("at"), o.alias("open"), f.alias("fav"), a.alias("adv"), m.alias("moved"), t.alias("timestamp"))
    none = lambda best: found(best, null("long"), null("double"), null("double"), null("double"), null("double"), null(at_type))
    merge = lambda acc, c: (
        F.when(acc["at"].isNotNull(), acc)
        .when(touched(acc["best"], c), found(acc["best"], c["i"], c["open"], fav(c), adv(c), moved(c), c["timestamp"]))
        .otherwise(none(F.greatest(acc["best"], moved(c))))
    )
    return F.aggregate(F.filter("children", lambda c: c["i"] >= F.col("next")), none(F.col("best")), merge)


def _step(state: DataFrame, tree: DataFrame, top: int, series: tuple[str, ...]) -> DataFrame:
    """Each open candidate meets one tree row; level -1 marks those that are done."""
    columns = state.columns
    looked = state.withColumn("parent", F.floor(F.col("next") / FAN)).join(tree, [*series, "level", "parent"], "left")
    looked = looked.withColumn("f", _scan(looked))
    hit, leaf = F.col("f.at").isNotNull(), F.col("level") == 0
    after = F.greatest("f.best", "f.moved")
    stop = after - F.col("s_dist")
    trail = F.col("trailing") & (after >= F.col("s_act")) & (F.col("f.adv") <= stop)
    reason = F.when(F.col("f.adv") <= F.col("s_sl"), "SL").when(trail, "TRAILING_STOP").when(F.col("f.fav") >= F.col("s_tp"), "TP")
    s_open = F.col("sign") * F.col("f.open")
    price = F.when(reason == "SL", F.least(s_open, "s_sl")).when(reason == "TP", F.col("s_tp")).otherwise(F.when(F.col("f.best") >= F.col("s_act"), F.least(s_open, stop)).otherwise(stop))
    exits = hit & leaf & reason.isNotNull()
    starts = hit & leaf & reason.isNull()
    over = F.col("children").isNull() | (~hit & (F.col("level") == top))
    done = F.col("level") < 0
    made = {
        "hit": F.when(done, F.col("hit")).when(exits, F.struct(reason.alias("reason"), F.col("f.at").alias("idx"), F.col("f.timestamp").alias("timestamp"), (F.col("sign") * price).alias("price"))),
        "next": F.when(done | over | exits, F.col("next")).when(starts, F.col("f.at") + 1).when(hit, F.col("f.at") * FAN).otherwise(F.col("parent") + 1),
        "best": F.when(done | over | exits, F.col("best")).when(starts, after).otherwise(F.col("f.best")),
        "level": F.when(done | over | exits, F.lit(-1)).when(starts, F.lit(0)).when(hit, F.col("level") - 1).otherwise(F.col("level") + 1),
    }
    looked = looked.withColumns({f"new_{k}": v for k, v in made.items()})
    plain = [c for c in columns if c not in {*made, "active"}]
    return looked.select(*plain, *[F.col(f"new_{k}").alias(k) for k in made], (F.col("active") | (F.col("new_best") >= F.col("s_act"))).alias("active")).select(*columns)


def first_hits(candidates: DataFrame, tree: DataFrame, top: int, series: tuple[str, ...] = ("symbol",), steps: int = STEPS) -> DataFrame:
    """Add ``hit`` (reason, idx, timestamp, price; null where nothing is touched up to the series' end).

    ``candidates`` have entry_idx, sign, s_sl, s_tp, s_act, s_dist, trailing and ``best``, from where the stop starts to follow.
    Every few steps are a checkpoint, and no step follows once all candidates are done.
    """
    at_type = next(f.dataType.simpleString() for f in tree.schema["children"].dataType.elementType if f.name == "timestamp")
    none = F.lit(None).cast(f"struct<reason:string,idx:bigint,timestamp:{at_type},price:double>")
    own = [*candidates.columns, "hit"]
    state = candidates.withColumns({"level": F.lit(0), "next": F.col("entry_idx") + 1, "active": F.col("best") >= F.col("s_act"), "hit": none})
    found = None
    while True:
        for _ in range(steps):
            state = _step(state, tree, top, series)
        state = cut(state)
        done = state.where("level < 0").select(*own)
        found = done if found is None else found.unionByName(done)
        state = state.where("level >= 0")
        if state.isEmpty():
            return found
