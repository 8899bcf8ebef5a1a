"""Ordered scans that never put one key into one task.

A key (a recording, say) may hold a third of all rows, so running counts, running maxima and lags are done in two
phases: inside fixed chunks of the order column, and over the small table of chunk totals. Chunk boundaries are a
function of the data, so a lost executor recomputes the same result. A scan evaluates its input twice (rows and totals);
callers that chain scans cut the lineage between them.

Rows meet the totals of their chunk by a sort-merge join, whose partitioning the windows need anyway. The planner knows only file sizes: it takes rows that
were multiplied for as small as the file they came from, and would send them through the driver.
"""
from pyspark.sql import DataFrame, Window, functions as F

FIRST, PREV = Window.unboundedPreceding, -1


def chunk_totals(df: DataFrame, keys, chunk, aggs, carried) -> DataFrame:
    """One row per (keys, chunk) with columns of `carried` computed over the preceding chunks."""
    per = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in aggs.items()])
    w = Window.partitionBy(*keys).orderBy(chunk)
    return per.select(*keys, chunk, *[f(w).alias(n) for n, f in carried.items()])


def ranked(df: DataFrame, keys, order, chunk, name="rk", total=None) -> DataFrame:
    """0-based rank of each row inside `keys` in `order`; `chunk` must be monotone in `order`."""
    return ranked_many(df, [(keys, name, total)], order, chunk)


def ranked_many(df: DataFrame, specs, order, chunk) -> DataFrame:
    """Several ranks (keys, name[, total]) in one order. All totals are taken from `df` itself, so it is evaluated once per
    rank and once for the rows, not twice per nesting level."""
    out = df
    for keys, name, *rest in specs:
        keys, total = list(keys), (rest[0] if rest else None)
        carried = {"_before": lambda w: F.coalesce(F.sum("_cnt").over(w.rowsBetween(FIRST, PREV)), F.lit(0))}
        if total:
            carried[total] = lambda w: F.sum("_cnt").over(w.rowsBetween(FIRST, Window.unboundedFollowing))
        tot = chunk_totals(df, keys, chunk, {"_cnt": F.count(F.lit(1))}, carried)
        inner = Window.partitionBy(*keys, chunk).orderBy(*order)
        out = out.join(tot.hint("merge"), [*keys, chunk]).withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).drop("_before")
    return out


def lagged(df: DataFrame, keys, order, chunk, values, prefix="prev_", ahead=False) -> DataFrame:
    """Columns `prev_<v>` of the preceding row inside `keys` (of the next one with `ahead`); NULL at the end."""
    s, o = F.struct(*values), F.struct(*order)
    shift = F.lead if ahead else F.lag
    edge = F.min_by(s, o) if ahead else F.max_by(s, o)
    tot = chunk_totals(df, keys, chunk, {"_edge": edge}, {"_carry": lambda w: shift("_edge").over(w)})
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    out = df.join(tot.hint("merge"), [*keys, chunk]).withColumn("_p", F.coalesce(shift(s).over(inner), F.col("_carry")))
    return out.select("*", *[F.col(f"_p.{v}").alias(prefix + v) for v in values]).drop("_p", "_carry")


def running(df: DataFrame, keys, order, chunk, value, fn, name, inclusive=True) -> DataFrame:
    """Running `fn` (F.sum or F.max) of `value` in `order` inside `keys`."""
    return running_many(df, keys, order, chunk, [(value, fn, name)], inclusive)


def running_many(df: DataFrame, keys, order, chunk, specs, inclusive=True) -> DataFrame:
    """Several running aggregates (value, fn, name) over the same keys and order, with one table of chunk totals."""
    aggs = {f"_v{i}": fn(v) for i, (v, fn, _) in enumerate(specs)}
    carried = {f"_c{i}": (lambda w, i=i, fn=fn: fn(f"_v{i}").over(w.rowsBetween(FIRST, PREV))) for i, (_, fn, _) in enumerate(specs)}
    tot = chunk_totals(df, keys, chunk, aggs, carried)
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(FIRST, 0 if inclusive else PREV)
    new = {}
    for i, (v, fn, name) in enumerate(specs):
        cur, old = fn(v).over(inner), F.col(f"_c{i}")
        new[name] = F.coalesce(old, F.lit(0)) + F.coalesce(cur, F.lit(0)) if fn is F.sum else F.greatest(old, cur)
    return df.join(tot.hint("merge"), [*keys, chunk]).withColumns(new).drop(*carried)
