"""Spelling variants: words one edit apart, each led to its more frequent form.

Words are counted in one pass, partial sums first. Near words are found by asymmetric q-chunks. A word of
length L, the chunk side, is cut into two disjoint chunks, its halves; one edit leaves one of them whole. The
other word, the gram side, holds that chunk as one of its positional grams, shifted by one at most: by
nothing if the edit lies behind the chunk, by the difference of the lengths if it lies before. The chunk side
is the longer word of a pair, so a gram side of length M asks for partners of length M and M + 1 only, and of
all its positional grams just those at an admissible shift are emitted, as no other could join.

A chunk alone is too common a key (``inter`` begins thousands of words), so the argument is used twice: the
half that holds the edit is two chunks again, one of which is whole. A key is thus the whole half and the
whole part of the other one: the word without the quarter of the edit. The candidates' verification is
their edit distance. A pair is taken at the one quarter that holds its first difference, so no pair is
found twice and nothing has to be made distinct.

A form has at least twice its word's count, so a chain of forms has no more links than the counts have
doublings; pointers are doubled so often that every chain is followed to its end.

Defined results: a null text has no words; a null id is written as an empty string before the colon of the
hashed key; rows that repeat an id or a text count each; an empty table gives no words; other columns are
ignored. A word has a bounded number of near words (alphabet x length), so no group grows with the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, MODULUS = 5, 3, 2, 97


def _lowered(run: Column) -> Column:
    """Only A-Z become small; ``lower`` does just that for a run of single bytes, and is faster."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, modulus: int | None = MODULUS) -> DataFrame:
    """(word, n) of the lower-cased runs of letters.

    Where ``modulus`` divides the checksum of ``id:run``, the run loses one code point before it is counted;
    None leaves all runs as they are.
    """
    runs = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]+"), 0)).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("id", _lowered(F.col("run")).alias("word"))
    if modulus:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select("word", h.alias("h")).select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cuts(length: Column) -> list[Column]:
    """Borders of a word's quarters: both halves are halved."""
    half = F.floor(length / 2)
    return [F.lit(0).cast("long"), F.floor(half / 2), half, half + F.floor((length - half) / 2), length.cast("long")]


def _keys(words: DataFrame, side: Column) -> DataFrame:
    """word, n, side (the chunk side's length), the quarter left out, where it ends, and the hash of what is left."""
    rows = words.withColumn("side", side)
    cuts = _cuts(F.col("side"))

    def key(k: int) -> Column:
        left = F.xxhash64("side", F.lit(k), F.substring("word", F.lit(1), cuts[k].cast("int")),
                          F.right("word", (F.col("side") - cuts[k + 1]).cast("int")))
        return F.struct(left.alias("key"), F.lit(k).alias("quarter"), cuts[k + 1].cast("int").alias("until"))

    return rows.select("word", "n", "side", F.inline(F.array(*[key(k) for k in range(4)])))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that differ by exactly one edit.

    Words need four code points at least, so that every quarter of the longer one has one.
    """
    length = F.length("word")
    chunks = _keys(words, length).select("key", "quarter", "until", "side", F.col("word").alias("x"), F.col("n").alias("x_n"))
    partners = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("partner"))
    grams = (_keys(partners, F.col("partner"))
             .select("key", "quarter", "side", F.col("word").alias("y"), F.col("n").alias("y_n")))
    pairs = chunks.hint("shuffle_merge").join(grams, ["key", "quarter", "side"])
    pairs = pairs.where((F.length("y") < F.length("x")) | (F.col("y") < F.col("x")))
    differs = F.substring("x", F.lit(1), F.col("until")) != F.substring("y", F.lit(1), F.col("until"))
    pairs = pairs.where(differs).where(F.levenshtein("x", "y", 1) == 1)
    return pairs.selectExpr("inline(array(named_struct('word', x, 'n', x_n, 'near', y, 'near_n', y_n), "
                            "named_struct('word', y, 'n', y_n, 'near', x, 'near_n', x_n)))")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n), whose words are distinct."""
    words = pinned(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    led = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    found = pinned(words.join(best, "word", "left").select(
        "word", F.when(led, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, -F.col("best.less")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    links = max(1, int(math.log(most, max(2, ratio))) + 1)
    step = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links)) + 1):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = pinned(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(word_counts(table(spark, folder, "documents")))


OP11_SQL = r"""
with recursive bits as (
    select i, i::ubigint as v, 0 as k from range(256) t(i)
    union all select i, xor(v >> 1, (v & 1) * 3988292384), k + 1 from bits where k < 8),
  bytes as materialized (select i::ubigint as i, v from bits where k = 8),
  runs as materialized (
    select coalesce(cast(doc_id as varchar), '') || ':' || run as s, run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
    where length(run) >= 5 group by all),
  sums as (
    select s, hex(encode(s)) as h, 0 as p, 4294967295::ubigint as c from (select distinct s from runs)
    union all select s, h, p + 2, xor(c >> 8, v)
    from sums join bytes on i = xor(c & 255, ('0x' || substr(h, p + 1, 2))::ubigint) where p < length(h)),
  h as materialized (select s, cast(xor(c, 4294967295) as bigint) as h from sums where p = length(h)),
  w as materialized (
    select word, cast(sum(n) as bigint) as n from (
      select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n
      from runs join h using (s))
    where length(word) >= 5 group by word having sum(n) >= 3),
  cut as materialized (
    select word, i, left(word, i) || substr(word, i + 2) as d
    from (select word, unnest(range(length(word))) as i from w)),
  shorter as materialized (select distinct cut.word, w.word as near from cut join w on d = w.word),
  near as materialized (
    select a.word, b.word as near from cut a join cut b on a.d = b.d and a.i = b.i and a.word <> b.word
    union all select word, near from shorter union all select near, word from shorter),
  best as (
    select word, count(*) as n_near, arg_min(near, (-n, near)) as near, max(n) as near_n
    from (select near.word, near.near, w.n from near join w on near.near = w.word) group by word),
  found as materialized (
    select w.word, case when near_n >= 2 * w.n then near end as form, w.n, coalesce(n_near, 0) as n_near,
      case when near_n >= 2 * w.n then near_n end as form_n
    from w left join best on w.word = best.word),
  chain as (
    select word, form, word as root, form as ahead from found
    union all select c.word, c.form, c.ahead, f.form from chain c join found f on c.ahead = f.word)
select found.word, found.form, chain.root, found.n, found.n_near, found.form_n
from found join chain on found.word = chain.word and chain.ahead is null"""
