"""Exact order statistics without a big task.

Medians, quantile edges and the cut points of splits and folds are single values of a
huge sorted column. Sorting the column (or a ``percentile`` over millions of distinct
values, or ``row_number`` inside a two-valued class) would push the data through a few
tasks. Quantiles come from brackets around the wanted ranks, which a sketch gives and a
second scan counts, cut points from counts per key prefix; both are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 1_000_000      # distinct values a bucket is meant to hold
INSIDE = 100_000        # values inside all brackets that the driver takes
_STEPS = 1024           # steps of a sketch's grid, and most buckets
_ACCURACY = 10_000      # a sketch's ranks are right to this part of the rows


def bucket_bounds(count: int, sketch: list | None, bucket: int = BUCKET) -> list:
    """Bounds that part ``count`` values into about equal buckets of ``bucket``, out of a sketch's quantiles."""
    parts = min(_STEPS, -(-count // bucket))
    if parts < 2 or not sketch:
        return []
    return sorted({sketch[k * _STEPS // parts - 1] for k in range(1, parts)})


def sketched(col: str | Column) -> Column:
    """The ``_STEPS`` - 1 inner quantiles of a column, approximately: bounds of buckets, never a result."""
    return F.percentile_approx(col, F.array(*[F.lit(k / _STEPS) for k in range(1, _STEPS)]), F.lit(_ACCURACY))


def bucket_of(x: Column, bounds: list) -> Column:
    """How many bounds lie below ``x``, by bisection in one nested conditional; 0 for null."""
    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x > F.lit(bounds[middle]), part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(bounds))


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _around(grid: list[float], p: float) -> tuple[float, float]:
    """Grid values that bracket quantile ``p``: two steps away, and then the next other value.

    Two steps are more than the sketch's rank error and the fraction of a rank together, or, where there are
    fewer values than steps, the grid holds every value and the next other one is a rank further.
    """
    low, high = grid[max(0, math.floor(p * _STEPS) - 2)], grid[min(_STEPS, math.ceil(p * _STEPS) + 2)]
    return (max([v for v in grid if v < low], default=-math.inf), min([v for v in grid if v > high], default=math.inf))


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Overlapping brackets joined, in rising order."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _segment(x: Column, brackets: list[tuple[float, float]]) -> Column:
    """2k for a value between brackets, 2k + 1 for one inside bracket k; null for null."""
    passed = [F.when(x >= F.lit(low), 1).otherwise(0) + F.when(x > F.lit(high), 1).otherwise(0) for low, high in brackets]
    return F.when(x.isNotNull(), reduce(add, passed, F.lit(0)))


def _tall(df: DataFrame, brackets: dict[str, list]) -> DataFrame:
    """(i, x, segment): a row per value of every column; only ``i`` is set for a null or NaN."""
    cells = [F.struct(F.lit(i).alias("i"), _value(c).alias("x")) for i, c in enumerate(brackets)]
    if len(cells) == 1:
        rows = df.select(F.lit(0).alias("i"), _value(next(iter(brackets))).alias("x"))
    else:
        rows = df.select(F.inline(F.array(*cells)))
    parts = [F.when(F.col("i") == i, _segment(F.col("x"), b)) for i, b in enumerate(brackets.values())]
    return rows.select("i", "x", F.coalesce(*parts).alias("segment"))


def _narrowed(tall: DataFrame, brackets: dict[str, list], wanted: dict[str, list[float]]) -> dict[str, list]:
    """Brackets inside the brackets, from the counts of all segments and sketches of those inside."""
    inside = F.when(F.col("segment") % 2 == 1, F.col("x"))
    seen: dict[int, dict] = {}
    for r in (tall.groupBy("i", "segment").agg(F.count("x").alias("n"), F.min("x").alias("least"), sketched(inside).alias("s"),
                                               F.max("x").alias("most")).collect()):
        if r["segment"] is not None:
            seen.setdefault(r["i"], {})[r["segment"]] = r
    out = {}
    for i, (c, probs) in enumerate(wanted.items()):
        segments, total = seen.get(i, {}), sum(r["n"] for r in seen.get(i, {}).values())
        found = []
        for rank in _ranks(probs, total):
            before = 0
            for k in sorted(segments):
                r = segments[k]
                if rank < before + r["n"]:
                    grid = [r["least"], *(r["s"] or []), r["most"]]
                    found.append(_around(grid, (rank - before) / r["n"]) if len(grid) > 2 else (r["least"], r["most"]))
                    break
                before += r["n"]
        out[c] = _merged(found)
    return out


def _ranks(probs: list[float], n: int) -> list[int]:
    return sorted({int(f(p * (n - 1))) for p in probs for f in (math.floor, math.ceil)}) if n else []


def _interpolated(probs: list[float], n: int, at: dict[int, float]) -> list[float | None]:
    out = []
    for p in probs:
        if not n:
            out.append(None)
            continue
        r = p * (n - 1)
        low, high = at[math.floor(r)], at[math.ceil(r)]
        out.append(low if low == high else (math.ceil(r) - r) * low + (r - math.floor(r)) * high)
    return out


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], by: str | None = None,
                    inside: int = INSIDE) -> dict:
    """Linear-interpolated quantiles: ``{group: {column: [value, ...]}}`` (group None without ``by``).

    A mergeable sketch brackets every wanted rank. One further scan counts the values between the brackets and
    keeps only those inside: some thousandths of the rows, of which equal ones are one, combined before the
    shuffle. While they are more than ``inside``, the brackets are narrowed by a sketch of what they hold, so
    the driver gets a bounded number of values at any size. A rank found outside its bracket (the
    sketch's error is bounded, so none should be) would be searched again there. Nulls and NaNs are left out; a column with no values gives ``[None, ...]``.
    With ``by``, for groups whose results fit the driver.
    """
    if by:
        result: dict = {}
        for c, probs in wanted.items():
            for r in quantile_table(df, c, probs, by).collect():
                if r[by] is not None:
                    result.setdefault(r[by], {})[c] = list(r["q"])
        return result
    cols = list(wanted)
    inside = max(inside, 32 * sum(map(len, wanted.values())))  # narrowest brackets hold some 14 values a quantile
    numbers = df.select(*[_value(c).alias(c) for c in cols])
    grids = numbers.approxQuantile(cols, [k / _STEPS for k in range(_STEPS + 1)], 1 / _ACCURACY)
    brackets = {c: _merged([_around(g, p) for p in wanted[c]] if g else []) for c, g in zip(cols, grids)}
    while True:
        tall = _tall(df, brackets)
        kept = F.when(F.col("segment") % 2 == 1, F.col("x")).alias("x")
        rows = tall.groupBy("i", "segment", kept).agg(F.count("segment").alias("n")).limit(inside + 1).collect()
        if len(rows) > inside:
            brackets = _narrowed(tall, brackets, wanted)
            continue
        found, missed = {}, {}
        for i, (c, probs) in enumerate(wanted.items()):
            mine = sorted((r["segment"], r["x"], r["n"]) for r in rows if r["i"] == i and r["segment"] is not None)
            total, at, before = sum(n for *_, n in mine), {}, 0
            ranks = _ranks(probs, total)
            for _, x, n in mine:
                at |= {r: x for r in ranks if before <= r < before + n}
                before += n
            if None in at.values():
                missed[c] = None
            else:
                found[c] = _interpolated(probs, total, at)
        if not missed:
            return {None: found}
        brackets = {c: b if c in found else [(-math.inf, math.inf)] for c, b in brackets.items()}


def quantile_table(df: DataFrame, col: str, probs: list[float], by: str) -> DataFrame:
    """(``by``, q): the quantiles of one column per group, the null group too, however many groups, as a DataFrame.

    The same two steps with the brackets as a table: a sketch per group brackets every rank, then rows below a
    bracket are one count and only values inside it are kept. Groups are joined to their brackets, so the plan does not grow with
    them; a group without values has nulls in ``q``.
    """
    # A struct is never null: a null filter on the group, as a join on a column implies, would be pushed below the
    # projections and repeat every expression behind it there.
    rows = df.select(F.struct(F.col(by).alias("by")).alias("g"), _value(col).alias("x"))
    steps = F.array(*[F.lit(k / _STEPS) for k in range(_STEPS + 1)])
    held = rows.groupBy("g").agg(F.count("x").alias("all"), F.percentile_approx("x", steps, F.lit(_ACCURACY)).alias("grid"))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probs)])
    held = held.withColumn("want", F.explode(asked)).selectExpr(
        "g", "all", "grid", "want.k as k", "want.p * (all - 1) as r",
        f"grid[int(greatest(0, floor(want.p * {_STEPS}) - 2))] as low", f"grid[int(least({_STEPS}, ceil(want.p * {_STEPS}) + 2))] as high")
    held = held.selectExpr("g", "all", "k", "r", "array_max(filter(grid, v -> v < low)) as low", "array_min(filter(grid, v -> v > high)) as high")
    held = held.groupBy("g", "all").agg(F.sort_array(F.collect_list(F.struct("k", "r", "low", "high"))).alias("brackets"))
    near = rows.join(held, "g").select("g", "x", F.explode("brackets").alias("b")).where("x is null or b.high is null or x <= b.high")
    inside = F.when(F.col("b.low").isNull() | (F.col("x") >= F.col("b.low")), F.col("x"))
    counts = near.groupBy("g", F.col("b.k").alias("k"), F.col("b.r").alias("r"), inside.alias("x")).agg(F.count(near["x"]).alias("n"))
    upto = F.sum("n").over(W.partitionBy("g", "k").orderBy(F.asc_nulls_first("x")))
    ends = counts.withColumn("upto", upto).groupBy("g", "k", "r").agg(
        F.min(F.when(F.col("upto") > F.floor("r"), F.col("x"))).alias("lo"), F.min(F.when(F.col("upto") > F.ceil("r"), F.col("x"))).alias("hi"))
    value = F.expr("if(lo = hi, lo, (ceil(r) - r) * lo + (r - floor(r)) * hi)")
    found = ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))).alias("q"))
    return found.select(F.col("g.by").alias(by), F.col("q.v").alias("q"))


def exact_medians(df: DataFrame, cols: list[str], by: str | None = None) -> dict:
    """Interpolated medians: ``{column: value}``, or ``{group: {column: value}}`` with ``by``."""
    found = exact_quantiles(df, {c: [0.5] for c in cols}, by)
    flat = {g: {c: v[0] for c, v in row.items()} for g, row in found.items()}
    return flat if by else flat.get(None, dict.fromkeys(cols))


def sortable_id(col: Column) -> Column:
    """A 64-bit integer as 16 hex digits that sort like the numbers do."""
    flipped = col.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.lower(F.lpad(F.hex(flipped), 16, "0"))


def hash_order(id_col: str, seed: int) -> Column:
    """A reproducible shuffled order: md5 of id and seed, the id breaking ties."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.concat(digest, sortable_id(F.col(id_col)))


def rank_cuts(df: DataFrame, by: str, key: Column, positions: Callable[[int], list[int]],
              leaf: int = 2000, width: int = 3) -> dict[object, list[str]]:
    """Key values that cut each group's sorted rows after given numbers of rows.

    ``positions(n)`` lists row counts for a group of ``n``; the returned key for ``p``
    is the p-th smallest (``""`` for 0). Keys are unique lower-case hex strings of one
    length. The search descends their digits: each round counts rows per next ``width``
    digits inside the few prefixes that still hold a cut, until such a prefix holds at
    most ``leaf`` rows. Digits common to all keys under a prefix are skipped.
    """
    keyed = df.select(F.col(by).alias("g"), key.alias("key"))
    groups: dict = {}
    length = 0
    for r in (keyed.groupBy("g", F.substring("key", 1, width).alias("p"))
              .agg(F.max(F.length("key")).alias("length"), *_bucket_measures(F.lit(1))).collect()):
        if r["g"] is not None and r["p"] is not None:
            groups.setdefault(r["g"], []).append((r["p"], r["n"], r["lo"], r["hi"]))
            length = max(length, r["length"])
    wanted = {g: positions(sum(n for _, n, _, _ in buckets)) for g, buckets in groups.items()}
    cuts: dict = {(g, p): "" for g, ps in wanted.items() for p in ps}
    pending: list[tuple] = []  # (group, position, rank under the prefix, prefix, rows under it)

    def descend(g, position, rank, base, buckets):
        """Move to the bucket that holds the rank and to all digits its keys share."""
        digits = min(_TAIL, length - len(base))
        for _, n, lo, hi in sorted(buckets):
            if rank <= n:
                prefix = base + commonprefix([f"{lo:0{digits}x}", f"{hi:0{digits}x}"])
                if len(prefix) == length:
                    cuts[g, position] = prefix
                else:
                    pending.append((g, position, rank, prefix, n))
                return
            rank -= n

    for g, ps in wanted.items():
        for p in ps:
            if p > 0:
                descend(g, p, p, "", groups[g])
    while pending:
        shallow = [t for t in pending if t[4] <= leaf]
        if shallow:
            keys = _leaf_keys(keyed, {(t[0], t[3]) for t in shallow})
            for g, p, rank, prefix, _ in shallow:
                cuts[g, p] = keys[g, prefix][rank - 1]
        deep, pending = [t for t in pending if t[4] > leaf], []
        if deep:
            below = _buckets_under(keyed, {(t[0], t[3]) for t in deep}, width)
            for g, p, rank, prefix, _ in deep:
                descend(g, p, rank, prefix, below[g, prefix])
    return {g: [cuts[g, p] for p in ps] for g, ps in wanted.items()}


_TAIL = 15  # hex digits that fit a long


def _bucket_measures(start: Column) -> list[Column]:
    """Rows of a bucket and the range of its keys' next digits.

    The range is taken over integers: a minimum of strings has no hash aggregate and
    would sort every row.
    """
    tail = F.conv(F.substring(F.col("key"), start, F.lit(_TAIL)), 16, 10).cast("long")
    return [F.count(F.lit(1)).alias("n"), F.min(tail).alias("lo"), F.max(tail).alias("hi")]


def _place_index(places: list[tuple]) -> Column:
    """Index of the (group, prefix) place a row lies in; null when in none."""
    branches = [F.when((F.col("g") == F.lit(g)) & F.col("key").startswith(p), i)
                for i, (g, p) in enumerate(places)]
    return F.coalesce(*branches)


def _buckets_under(keyed: DataFrame, places: set, width: int) -> dict:
    """Measures per next ``width`` digits under each place."""
    ordered = sorted(places, key=str)
    start = F.element_at(F.array(*[F.lit(len(p) + 1) for _, p in ordered]), F.col("i") + 1)
    rows = (keyed.withColumn("i", _place_index(ordered)).withColumn("start", start)
            .groupBy("i", F.substring(F.col("key"), F.col("start"), F.lit(width)).alias("p"))
            .agg(*_bucket_measures(F.col("start"))).collect())
    out: dict = {place: [] for place in ordered}
    for r in rows:
        if r["i"] is not None:          # rows elsewhere fold into the one null group
            out[ordered[r["i"]]].append((r["p"], r["n"], r["lo"], r["hi"]))
    return out


def _leaf_keys(keyed: DataFrame, places: set) -> dict:
    """The sorted keys under each place; a place holds at most ``leaf`` rows."""
    ordered = sorted(places, key=str)
    inside = F.when(F.col("i").isNotNull(), F.col("key"))
    rows = (keyed.withColumn("i", _place_index(ordered))
            .groupBy("i").agg(F.collect_list(inside).alias("keys")).collect())
    return {ordered[r["i"]]: sorted(r["keys"]) for r in rows if r["i"] is not None}
