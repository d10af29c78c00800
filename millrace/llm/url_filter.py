"""URL rules by a Bloom filter cascade: exact membership without joins.

A rule is a host and the beginning of a path; it fits that host and all its
subdomains.  Which rules can fit a URL is a matter of its own *keys*: each
suffix of its host with each beginning of its path that has the length of
some rule's path.  So matching is a membership test of keys among the rules.

The cascade (Larisch et al. 2017) makes that test exact over the corpus's
complete universe of keys.  Level 0 is a Bloom filter of the rules' keys;
level 1 holds the keys of the universe that level 0 takes falsely; level 2
the rules' keys that level 1 takes falsely; and so on until none are left.
The first level that rejects a key decides: an even level says no, an odd one
yes.  With the error rate of level 0 set by the sizes of both sides, all
levels together are a few bytes a rule and grow only by the logarithm of the
corpus, so the cascade can go to every task; its size is checked all the same,
and beyond BROADCAST_BYTES keys are joined with the rules instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name, lookup, quoted, stored

#: The largest cascade that is sent to tasks.
BROADCAST_BYTES = 64 << 20
#: Rules that the driver takes to build a cascade; more are joined.
CASCADE_RULES = 1 << 22


class Bloom:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, keys: np.ndarray, rate: float, seed: int):
        n = max(len(keys), 1)
        self.seed = seed
        self.bits = max(64, int(math.ceil(-n * math.log(rate) / math.log(2) ** 2)))
        self.count = max(1, round(self.bits / n * math.log(2)))
        self.table = np.zeros(self.bits // 8 + 1, np.uint8)
        at = self._at(keys).ravel() if len(keys) else np.zeros(0, np.int64)
        np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, keys: np.ndarray) -> np.ndarray:
        k = np.arange(self.count, dtype=np.uint64)[:, None]
        a = keys[:, 0] ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64)
        b = keys[:, 1] * np.uint64(2 * self.seed + 1) | np.uint64(1)
        h = a[None, :] * np.uint64(0xBF58476D1CE4E5B9) + b[None, :] * (k + np.uint64(1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((h >> np.uint64(20)) % np.uint64(self.bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        return ((self.table[at >> 3] >> (at & 7)) & 1).all(0)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (a row of two hashes) is listed: exact for keys of the universe it was built over."""
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            taken = level.has(keys[open_])
            # Rejected by an odd level: listed.  Rejected by an even one: not.
            out[open_[~taken]] = k % 2 == 1
            open_ = open_[taken]
        out[open_] = len(self.levels) % 2 == 1
        return out

    @property
    def size(self) -> int:
        return sum(len(x.table) for x in self.levels)


def _pair(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def _tested(test, hashes: Column) -> Column:
    """What ``test`` says (a small number) of every key, from an array of the keys' hashes, for a batch at once."""

    @F.pandas_udf("array<byte>")
    def run(arrays: pd.Series) -> pd.Series:
        ends = np.cumsum([len(x) for x in arrays]) // 2
        flat = np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64).view(np.uint64).reshape(-1, 2)
        said = test(flat).astype(np.int8)
        return pd.Series([said[e - len(x) // 2 : e] for x, e in zip(arrays, ends, strict=True)])

    return run(hashes)


def _hashes(keys: str) -> Column:
    """Both hashes of every key of an array, one after the other."""
    return F.flatten(F.transform(keys, lambda k: F.array(*_pair(k))))


def build(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of ``listed`` (column ``key``) over ``universe`` (column ``keys``: arrays of keys).

    ``universe`` is read twice or more; duplicates in it do no harm.  None if
    there are too many rules for a cascade on the driver.
    """
    rules = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n = rules.count()
    if n > CASCADE_RULES:
        return None

    def pick(df: DataFrame) -> np.ndarray:
        a, b = _pair(F.col("key"))
        found = df.select(a.alias("a"), b.alias("b")).toArrow()
        return np.stack([found[c].to_numpy() for c in ("a", "b")], 1).astype(np.int64).view(np.uint64)

    own = pick(rules)
    size = universe.select(F.explode("keys").alias("key")).agg(F.approx_count_distinct("key", 0.05)).first()[0] or 1
    rate = min(0.5, max(n, 1) / (math.sqrt(2) * max(size - n, 1)))
    levels = [Bloom(own, rate, 1)]
    taken = universe.withColumn("hit", _tested(levels[0].has, _hashes("keys"))).select(
        F.explode(F.arrays_zip("keys", "hit")).alias("z")
    )
    # What level 0 takes falsely is about as many keys as there are rules.
    false = taken.where("z.hit > 0").select(F.col("z.keys").alias("key")).distinct().join(rules, "key", "left_anti")
    sides = [pick(false), own]
    while len(sides[0]):
        if len(levels) > 200:
            raise RuntimeError("two keys share both hashes")
        levels.append(Bloom(sides[0], 0.5, len(levels) + 1))
        sides = [sides[1][levels[-1].has(sides[1])], sides[0]]
    return Cascade(levels)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule fitting ``host`` and ``path`` can have, for rules whose paths have these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.when(
        host != "",
        F.array_distinct(
            F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
        ),
    ).otherwise(F.array().cast("array<string>"))


def judge(df: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``df``.

    ``rules`` has ``host``, ``path`` (its beginning, empty for any) and
    ``verdict``.  The longest rule that fits decides; ``default`` holds where
    none fits, that is where the cascades find no key of the URL listed.

    Edge cases: a null url, or one without ``://``, has empty host and path,
    so no rule fits; rules with null host or verdict are left out, a null path
    is empty; a rule that no url can fit (a host with ``/ ? #``, a path that is
    neither empty nor begins with ``/``) fits none; a rule listed with both
    verdicts blocks; repeated rows are judged
    alike; columns of these names in ``df`` are replaced, others kept; empty
    tables give no rows, and no rules give ``default`` throughout.
    """
    known = stored(
        # A host holds no slash and a path begins with one, so a key says where its host ends.
        rules.where("host IS NOT NULL AND verdict IS NOT NULL AND host NOT RLIKE '[/?#]' AND coalesce(path, '') RLIKE '^(/|$)'")
        .select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "verdict")
        .groupBy("key", "n")
        .agg(F.max(F.col("verdict") == "block").alias("blocks")),
        "url-rules",
    )
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    hosted = df.select(*quoted(keep), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not lengths:
        return hosted.select(*quoted(keep), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys, hit, top = (free_name(hosted.columns, x) for x in ("__keys", "__hit", "__best"))
    keyed = hosted.withColumn(keys, keys_of(F.col("host"), F.col("path"), lengths))
    listed = build(known, keyed.select(F.col(keys).alias("keys")))
    # Only listed keys are asked whether they block, so these are that cascade's universe.
    blocked = build(known.where("blocks"), known.select(F.array("key").alias("keys")))
    if listed is None or blocked is None or listed.size + blocked.size > BROADCAST_BYTES:
        return _joined(keyed, known, keep, default, keys)

    def test(h: np.ndarray) -> np.ndarray:
        a = listed.has(h)
        return a.astype(np.int8) + (a & blocked.has(h))

    flagged = keyed.withColumn(hit, _tested(test, _hashes(keys)))
    zipped = F.transform(
        F.arrays_zip(F.col(keys).alias("key"), F.col(hit).alias("hit")),
        lambda z: F.struct(F.length(z["key"]).alias("n"), z["key"].alias("key"), z["hit"].alias("hit")),
    )
    best = F.array_max(F.filter(zipped, lambda z: z["hit"] > 0))
    return flagged.withColumn(top, best).select(
        *quoted(keep),
        "host",
        "path",
        F.col(top)["key"].alias("rule"),
        F.when(F.col(top)["hit"] == 2, "block").when(F.col(top)["hit"] == 1, "allow").otherwise(default).alias("verdict"),
    )


def _joined(keyed: DataFrame, known: DataFrame, keep: list[str], default: str, held: str) -> DataFrame:
    """The same verdicts by a skew-safe lookup of keys, for rules too many for a cascade."""
    row, top = (free_name(keyed.columns, x) for x in ("__row", "__best"))
    rows = stored(keyed.withColumn(row, F.monotonically_increasing_id()), "url-rows")
    keys = rows.select(F.col(row).alias("row"), F.explode(held).alias("key"))
    weights = keys.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    table = stored(known.join(weights, "key").select("key", "blocks", "w"), "url-keys")
    hits = lookup(keys, table, ["key"], "w", keys.count()).where("blocks IS NOT NULL")
    best = hits.groupBy(F.col("row").alias(row)).agg(F.max(F.struct(F.length("key").alias("n"), "key", "blocks")).alias(top))
    return rows.join(best, row, "left").select(
        *quoted(keep),
        "host",
        "path",
        F.col(top)["key"].alias("rule"),
        F.when(F.col(top)["blocks"], "block").when(~F.col(top)["blocks"], "allow").otherwise(default).alias("verdict"),
    )


#: The rules of op1.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page's url; URLs under no rule are allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
