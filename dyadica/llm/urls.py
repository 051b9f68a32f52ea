"""URL filters by a cascade of Bloom filters.

A rule is a host and a path; it fits the host and its subdomains if the url's path starts with the rule's.
The *candidates* of a url are the keys host suffix + path prefix that any rule could have: one suffix per
label, one prefix per path length in the rule list. The universe is the distinct candidates of the corpus.

Level 1 of the cascade encodes the listed keys. Level 2 encodes the universe's keys that pass level 1
without being listed, level 3 the listed keys that pass level 2 as well, and so on until a level has no
false positives. A key of the universe is listed exactly if the first level that lacks it is an even one,
so every url of the corpus is judged exactly, with no join: the cascade is a few bits per rule.

Sizes: the rule list is a parameter of at most ``MAX_RULES`` rules, held by the driver. Level 1 gets a
false-positive rate of rules / universe, so level 2 encodes about as many keys as there are rules however
large the corpus is; the levels after it halve. Its bits grow with the logarithm of the universe only.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a url without
a rule gets the verdict ``default``, as its keys are not listed; of fitting rules the longest host + path
wins, of equally long ones the longer host; extra columns are ignored; rows may repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_RULES = 1_000_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
_MASK = (1 << 64) - 1


class Bloom:
    """A Bloom filter over strings with positions from one 128-bit hash per key."""

    def __init__(self, keys: Sequence[str], rate: float, seed: int):
        self.seed = seed
        self.bits = max(64, math.ceil(max(1, len(keys)) * -math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, len(keys)) * math.log(2)))
        self.data = bytearray(-(-self.bits // 8))
        for key in keys:
            for at in self._positions(key):
                self.data[at >> 3] |= 1 << (at & 7)

    def _positions(self, key: str) -> Iterator[int]:
        import xxhash
        digest = xxhash.xxh128_intdigest(key.encode(), seed=self.seed)
        first, step = digest & _MASK, (digest >> 64) | 1
        return (((first + i * step) & _MASK) % self.bits for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.data[at >> 3] >> (at & 7) & 1 for at in self._positions(key))


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def candidates(host: str, path: str, lengths: Sequence[int]) -> Iterator[str]:
    """Keys of a url from the longest to the shortest, longer hosts first; no host, no keys."""
    if not host:
        return
    starts = [0] + [i + 1 for i, c in enumerate(host) if c == "."]
    pairs = [(-(len(host) - s) - n, s, n) for s in starts for n in lengths if n <= len(path)]
    for _, s, n in sorted(pairs):
        yield host[s:] + path[:n]  # no host holds a slash, so the key tells host and path apart


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host and path of every row; only these columns are read."""
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", F.translate(host, upper, lower).alias("host"), path.alias("path"))


def build_cascade(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> Cascade:
    """The cascade over the candidates of ``urls`` (host, path) for the keys of ``rules``."""
    listed = sorted({host + path for _, host, path in rules})
    if len(listed) > MAX_RULES:
        raise ValueError(f"{len(listed)} rules; at most {MAX_RULES} are held in one cascade")
    lengths = sorted({len(path) for _, _, path in rules})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {k for h, p in zip(batch["host"], batch["path"]) for k in candidates(h, p, lengths)}
            if found:
                yield pd.DataFrame({"key": list(found)})

    universe = urls.mapInPandas(keys, "key string").distinct()
    size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    known = set(listed)
    rate = min(0.5, max(1e-12, len(listed) / size))
    while True:
        first = Bloom(listed, rate, 1)
        bound = 16 * len(listed) + 1000

        def passing(batches: Iterator[pd.DataFrame], first=first) -> Iterator[pd.DataFrame]:
            for batch in batches:
                kept = [k for k in batch["key"] if k in first and k not in known]
                if kept:
                    yield pd.DataFrame({"key": kept})

        wrong = universe.mapInPandas(passing, "key string").limit(bound + 1).collect()
        if len(wrong) <= bound:
            break
        rate /= 16  # an unlucky filter; nothing is dropped, a finer one is built
    levels, inside, outside = [first], listed, sorted(r["key"] for r in wrong)
    while outside:
        level = Bloom(outside, 0.5 if len(levels) > 1 else 0.25, len(levels) + 1)
        levels.append(level)
        inside, outside = outside, [k for k in inside if k in level]
    return Cascade(levels)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow",
                url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    urls = split_url(pages, url)
    lengths = sorted({len(path) for _, _, path in rules})
    listed = build_cascade(urls.select("host", "path"), rules)
    blocked = build_cascade(urls.select("host", "path"), [r for r in rules if r[0] == "block"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rule = [next((k for k in candidates(h, p, lengths) if k in listed), None)
                    for h, p in zip(batch["host"], batch["path"])]
            verdict = [default if r is None else "block" if r in blocked else "allow" for r in rule]
            yield batch.assign(rule=pd.Series(rule, dtype=object, index=batch.index), verdict=verdict)

    kind = dict(urls.dtypes)["page_id"]
    return urls.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


OP4_SQL = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
  h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
  r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
          ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rule_host, rule_path)),
  f as (select page_id, host, path, rule_host || rule_path as rule, verdict,
          row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as nth
        from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from h left join f on h.page_id = f.page_id and f.nth = 1"""
