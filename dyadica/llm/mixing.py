"""Mixing sources to target weights.

The words of a source form one stream, its documents in the order of their id's digest, cut into blocks of
a fixed length. The mix is a sequence of slots of one block each, grouped into output shards:

1. Targets: sources by code point (null last) weigh ``weights``, repeating, and share ``share`` of all
   words; none gets more than ``max_repeat`` times its size, the excess goes to the others by weight.
2. Each shard draws its source counts from the multinomial law of the targets, slot by slot from a hash.
3. The counts of a source, summed over the shards before, number its slots. Draws beyond its quota are
   void and slots left undrawn are dealt to shards by hash, so every target is met to the word.
4. Slot ``i`` of a source reads block ``perm(i)`` of its epoch, an affine permutation that depends on the
   source's rank and the epoch. The short block at a stream's end comes last in every epoch; the
   last slot of a source may take only the head of its block.
5. Slots and documents join on (source, block), which no source dominates.

All of it is DataFrame work. Prefix sums run in two levels (totals of 4096 digest ranges, then inside a
range), so no window holds a whole source.

Defined results: a null text has no words; a null source is a source; documents without words take
nothing; sources without words have target 0; repeated rows are separate documents; an empty table gives
an empty mix. Runs agree, since nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, free_name, id_digest, pinned, table, word_count, written

BLOCK = 256
SHARD_SLOTS = 4096
#: Primes over 2**29: a number under 2**58 is a multiple of one of them at most, so two suffice.
_STEPS = (715_827_883, 1_073_741_789)


def _sizes(docs: DataFrame, id_col: str, source_col: str, size: Column, row_col: str | None) -> DataFrame:
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       size.alias("size"), row.alias("row"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
            max_repeat: int = 2) -> DataFrame:
    """One row per source: source, rank, source_size, weight, target, quota (whole words)."""
    given = F.array(*[F.lit(float(w)) for w in weights])
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("rank", F.row_number().over(by_source) - 1)
              .withColumn("weight", F.element_at(given, (F.col("rank") % len(weights) + 1).cast("int"))))
    # Sources reach their bound in the order of bound over weight. With the first k of them at
    # their bounds, the others get level * weight; a source is at its bound if it would pass it.
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bound = (max_repeat * F.col("source_size")).cast("double")
    level = ((F.sum("source_size").over(whole) * share
              - F.coalesce(F.sum(bound).over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levelled = (ranked.withColumn("level", level).withColumn("bound", bound)
                .withColumn("full", F.col("level") * F.col("weight") >= F.col("bound"))
                .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole)))
    target = F.when(F.col("full"), F.col("bound")).otherwise(F.col("level") * F.col("weight"))
    return levelled.select("source", "rank", "source_size", "weight", target.alias("target"),
                           F.least(F.round(target), "bound").cast("long").alias("quota"))


def _streams(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the words of the source before the document."""
    placed = sizes.withColumn("digest", id_digest(F.col("doc_id"))).withColumn("part", F.substring("digest", 1, 3))
    order = [F.col("digest"), F.col("doc_id"), F.col("size"), F.col("row")]
    inside = W.partitionBy("source", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    over = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    keys = ["source", "part"]
    same = [placed[k].eqNullSafe(parts[k]) for k in keys]
    joined = placed.join(parts, same[0] & same[1], "left").drop(parts["source"]).drop(parts["part"])
    return joined.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def _perm(i: Column, n: Column, rank: Column, epoch: Column) -> Column:
    """Where ``i`` in 0..n-1 goes: ``step * i + shift`` modulo n, with a step prime to n."""
    first, second = _STEPS
    step = F.when(n % first != 0, F.lit(first)).otherwise(F.lit(second)) % n
    shift = (rank * 40_503 + epoch * 2_654_435_761) % n
    narrow = (step * i + shift) % n
    wide = (step.cast("decimal(19,0)") * i.cast("decimal(19,0)") + shift) % n.cast("decimal(19,0)")
    return F.when(n < 2_000_000_000, narrow).otherwise(wide.cast("long"))


def mixing_slots(sizes: DataFrame, goals: DataFrame, block: int = BLOCK,
                 shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The plan: one row per slot: source, rank, shard, slot, epoch, block, words (taken from its head)."""
    whole = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    size, quota = F.col("source_size"), F.col("quota")
    plan = (goals.where("source_size > 0 and quota > 0")
            .withColumn("n_full", F.floor(size / block))
            .withColumn("epochs", F.floor(quota / size))
            .withColumn("rest", quota - F.col("epochs") * size)
            .withColumn("per_epoch", F.ceil(size / block))
            .withColumn("slots", F.col("epochs") * F.col("per_epoch") + F.ceil(F.col("rest") / block))
            .withColumn("first_slot", F.coalesce(F.sum("slots").over(whole), F.lit(0))))
    plan = pinned(plan)
    total = plan.agg(F.sum("slots")).first()[0] or 0
    n_shards = -(-total // shard_slots)
    # A uniform number for each slot of a shard falls into the quota range of one source: both meet on the
    # range's cells, as wide as a shard, so a draw sees a few sources however many there are.
    draws = (plan.sparkSession.range(n_shards).withColumnRenamed("id", "shard")
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.least(
                 F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots).cast("int") - 1)))
             .select("shard", F.pmod(F.xxhash64("shard", "k"), F.lit(max(total, 1))).alias("drawn"))
             .withColumn("cell", F.floor(F.col("drawn") / shard_slots)))
    last_slot = F.col("first_slot") + F.col("slots") - 1
    steps = plan.select("rank", "first_slot", last_slot.alias("last_slot"), F.explode(F.sequence(
        F.floor(F.col("first_slot") / shard_slots), F.floor(last_slot / shard_slots))).alias("cell"))
    # The planner takes exploded rows for as few as those they come from, so joins with them are told not to broadcast.
    counts = (draws.hint("merge").join(steps, "cell").where("drawn between first_slot and last_slot")
              .groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")))
    earlier = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = pinned(counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    known = ["rank", "source", "n_full", "epochs", "per_epoch", "rest"]
    used = (counts.join(plan, "rank").where("offset < slots")
            .select(*known, "shard", F.explode(F.sequence(
                F.col("offset"), F.least(F.col("offset") + F.col("n"), F.col("slots")) - 1)).alias("slot")))
    short = (plan.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
             .select(*known, F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("slot"))
             .select(*known, F.pmod(F.xxhash64("rank", "slot"), F.lit(max(n_shards, 1))).alias("shard"), "slot"))
    slots = used.unionByName(short)
    inner = F.col("slot") % F.col("per_epoch")
    n_full = F.col("n_full")
    return (slots.withColumn("epoch", F.floor(F.col("slot") / F.col("per_epoch")))
            .withColumn("inner", inner)
            .withColumn("block", F.when(F.col("inner") >= n_full, n_full).otherwise(
                _perm(F.col("inner"), F.greatest(n_full, F.lit(1)), F.col("rank"), F.col("epoch"))))
            .withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.lit(block).cast("long")).otherwise(
                F.least(F.lit(block).cast("long"), F.col("rest") - F.col("inner") * block)))
            .select("source", "rank", "shard", "slot", "epoch", "block", "words"))


def mix_pieces(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
               block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
               row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their sizes, targets, pieces).

    A piece is the part of a document in one slot: doc_id, row (the document's in the sizes: ``row_col``, or numbered
    there), source, size, shard, slot, epoch, and the document's words ``from_word`` up to before ``to_word``.
    """
    sizes = pinned(_sizes(docs, id_col, source_col, word_count(F.col(f"`{text_col}`")), row_col))
    goals = pinned(targets(sizes, weights, share, max_repeat))
    slots = mixing_slots(sizes, goals, block, shard_slots)
    ends = F.floor((F.col("start") + F.col("size") - 1) / block)
    held = (_streams(sizes.where("size > 0"))
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), ends))))
    joined = held.join(slots.withColumnRenamed("source", "slot_source").hint("merge"),
                       F.col("source").eqNullSafe(F.col("slot_source")) & (held["block"] == slots["block"]))
    base = held["block"] * block
    start, size = F.col("start"), F.col("size")
    pieces = (joined.withColumn("from_word", F.greatest(base - start, F.lit(0)))
              .withColumn("to_word", F.least(base + F.col("words") - start, size))
              .where("to_word > from_word")
              .select("doc_id", "row", "source", "size", "shard", "slot", "epoch", "from_word", "to_word"))
    return sizes, goals, pieces


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    sizes, goals, pieces = mix_pieces(table(spark, folder, "documents"))
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    known = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    return (sizes.join(known, F.col("source").eqNullSafe(F.col("goal_source")))
            .join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", **settings) -> DataFrame:
    """The mix as documents: a row of ``docs`` for every epoch that takes some of its words.

    A document whose words an epoch takes all keeps its text as it is; else the text is the taken words,
    joined by single spaces. Documents without words go, they have no share in any mix. Rows are told apart by a
    key that is written with them, so those that repeat an id or have none each stand for themselves.
    """
    key = free_name(docs, "mix_row")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    _, _, pieces = mix_pieces(rows, id_col, source_col, text_col, row_col=key, **settings)
    runs = (pieces.groupBy("row", "size", "epoch")
            .agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"),
                 F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("spans")))
    own, spans, whole, words = (free_name(docs, n) for n in ("mix_id", "mix_spans", "mix_whole", "mix_words"))
    runs = runs.select(F.col("row").alias(own), (F.col("n") == F.col("size")).alias(whole), F.col("spans").alias(spans))
    text = F.col(f"`{text_col}`")
    cut = F.expr(f"array_join(flatten(transform(`{spans}`, s -> slice(`{words}`, cast(s.from_word + 1 as int), "
                 f"cast(s.to_word - s.from_word as int)))), ' ')")
    joined = (rows.join(runs, rows[key] == runs[own])
              .withColumn(words, F.when(F.col(whole), F.array().cast("array<string>")).otherwise(
                  F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)")))))
    mixed = joined.withColumn(text_col, F.when(F.col(whole), text).otherwise(cut))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


OP2_SQL = f"""
with d as materialized (select row_number() over () as row_id, doc_id, source, md5(cast(doc_id as varchar)) as digest,
      cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
  s as (select source, cast(sum(size) as bigint) as source_size,
      row_number() over (order by source nulls last) - 1 as rnk from d group by source),
  w as (select *, cast([5, 2, 1][rnk % 3 + 1] as double) as weight from s),
  v as (select *, (sum(source_size) over () * 1.5::double
        - coalesce(sum(cast(2 * source_size as double)) over (order by source_size / weight, rnk
            rows between unbounded preceding and 1 preceding), 0.0))
      / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, rnk
            rows between unbounded preceding and 1 preceding), 0.0)) as level from w),
  l as (select *, max(level) filter (where level * weight < 2 * source_size) over () as lvl from v),
  t as (select source, rnk, source_size, case when level * weight >= 2 * source_size
      then cast(2 * source_size as double) else lvl * weight end as target from l),
  q as (select *, cast(least(round(target), 2.0 * source_size) as bigint) as quota from t),
  p as (select *, source_size // {BLOCK} as n_full, quota // nullif(source_size, 0) as epochs,
      (source_size + {BLOCK - 1}) // {BLOCK} as per_epoch from q where source_size > 0 and quota > 0),
  r as (select *, quota - epochs * source_size as rest from p),
  b as (select *, epochs * per_epoch + (rest + {BLOCK - 1}) // {BLOCK} as slots from r),
  k as (select *, unnest(range(slots)) as slot from b),
  e as (select *, slot // per_epoch as epoch, slot % per_epoch as nth,
      case when n_full % {_STEPS[0]} <> 0 then {_STEPS[0]} else {_STEPS[1]} end as step from k),
  x as (select source, case when nth >= n_full then n_full else
        ((step % greatest(n_full, 1)) * nth + (rnk * 40503 + epoch * 2654435761) % greatest(n_full, 1)) % greatest(n_full, 1) end as block,
      case when epoch < epochs then {BLOCK} else least({BLOCK}, rest - nth * {BLOCK}) end as words from e),
  o as (select *, coalesce(cast(sum(size) over (partition by source order by digest, doc_id, size, row_id
      rows between unbounded preceding and 1 preceding) as bigint), 0) as start from d where size > 0),
  h as (select *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as block from o),
  m as (select h.row_id, cast(sum(greatest(0, least(h.block * {BLOCK} + words - start, size)
      - greatest(h.block * {BLOCK} - start, 0))) as bigint) as taken
    from h join x on h.source is not distinct from x.source and h.block = x.block group by h.row_id)
select d.doc_id, d.size, t.source_size, t.target, coalesce(m.taken, 0) as taken
from d join t on d.source is not distinct from t.source left join m on d.row_id = m.row_id"""
