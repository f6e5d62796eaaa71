"""URL filtering with a cascade of Bloom filters; DataFrame functions only.

A list of keys is stored as a cascade (Salikhov et al., 2014; Larisch et al.,
2017): level 1 encodes the listed keys that occur in the corpus; level 2 the
keys of the corpus that level 1 takes for listed though they aren't; level 3 the
listed keys that level 2 takes for those; and so on until a level has no false
positive left.  A key of the corpus is listed if the first level that denies it
has an even number.  Over the complete key universe of the corpus the answer is
exact, and it needs no join: the levels are constants in the expression.

Size: the first level is sized so that about as many false positives as listed
keys remain, so all levels together take a few bits times log2(universe/list)
per listed key.  That bound is checked: constants of a plan can't hold more, so a
list of more than ``MAX_KEYS`` keys of the corpus, rules or domains, is looked up by
a join with the corpus' distinct keys instead.  Either way the answers are exact.

Hosts and paths: the host stands behind the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z in lower case; the path follows up to ``?``, ``#`` or the
end.  A null url, or one without ``://``, has neither and fits no rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import carried, lower_ascii, materialize

#: Bits of all levels together that may be sent with a query: 4 MB.
MAX_FILTER_BITS = 1 << 25
MAX_LEVELS = 40
HASHES = 6
#: Largest list that is turned into constants.
MAX_KEYS = MAX_FILTER_BITS // 64


@dataclass
class Level:
    """One Bloom filter: 64-bit words, as text that the optimizer folds into an array."""

    number: int
    bits: int
    words: list[int] = field(repr=False)

    def maybe(self, key: Column) -> Column:
        """False if the key isn't encoded; the k bits come from two hashes (Kirsch and Mitzenmacher, 2006)."""
        if not any(self.words):
            return F.lit(False)
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        # the words stand in the plan once, not once for each bit; the first bit that is off ends the search
        return F.forall(F.array(*[bit_of(key, self.number, k, self.bits) for k in range(HASHES)]), lambda at: F.getbit(F.element_at(words, F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1)


def bit_of(key: Column, level: int, k: int, bits: int) -> Column:
    """The k-th bit position of a key in a level's filter."""
    a = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(1 << 40))
    b = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(1 << 40))
    return F.pmod(a + F.lit(k) * b, F.lit(bits))


def encode_level(keys: DataFrame, number: int, bits: int) -> Level:
    """The filter of a column ``key``: bits are gathered per word where they arise, then once per word."""
    positions = keys.select(F.explode(F.array(*[bit_of(F.col("key"), number, k, bits) for k in range(HASHES)])).alias("at"))
    words = positions.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("v"))
    out = [0] * (bits // 64)
    for row in words.collect():  # at most bits / 64 rows, bounded by MAX_FILTER_BITS
        out[row.w] = row.v
    return Level(number, bits, out)


class Cascade:
    """Exact membership of a list within a universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """True if key, one of the universe, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.maybe(key), answer).otherwise(F.lit(level.number % 2 == 0))
        return answer

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of ``listed`` (column key) over ``universe`` (column key, distinct); None if it would be too large.

    The universe is read once per level pair and only the false positives of the
    level before are kept, so the tables shrink as levels are added.
    """
    inside = materialize(universe.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    r = inside.count()
    if r > MAX_KEYS:
        return None
    if r == 0:
        return Cascade([])
    s = max(universe.count() - r, 1)
    sides = [inside, universe.join(inside, "key", "left_anti")]
    levels: list[Level] = []
    encode, n, other = inside, r, max(s, r)
    for number in range(1, MAX_LEVELS + 1):
        rate = min(0.5, max(n / max(other, 1), 1e-9))
        bits = max(64, math.ceil(max(1.44 * math.log2(1 / rate), 2.0) * 1.5 * n / 64) * 64)
        levels.append(level := encode_level(encode, number, bits))
        wrong = materialize(sides[number % 2].where(level.maybe(F.col("key"))), f"cascade-{number}")
        sides[number % 2] = wrong
        n, other = wrong.count(), n
        if n == 0:
            return Cascade(levels)
        encode = wrong
    raise RuntimeError(f"false positives are left after {MAX_LEVELS} levels")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all domains above it, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule of one of these path lengths that would fit the url: domain and start of the path."""
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)])
    starts = F.filter(starts, lambda x: x.isNotNull())
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(starts, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: dict[str, str], blocked_domains: list[str] | DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """keep columns, host, path, rule, verdict (allow or block) of each row.

    rules: host and path start, to allow or block; the longest rule that fits
    wins, of equal lengths the one with the longer host.  Without a rule, a url
    is blocked if its host or a domain above it is in ``blocked_domains``, a
    list or, for long ones, a table with a column ``key``.
    All lists are looked up in cascades over all keys that the corpus' urls
    make: rules among the keys, allowing ones among the rules, and domains.
    Empty urls fit nothing and are allowed; repeated rows all get their verdict.
    A carried column named like a result's gets ``in_`` before its name.
    """
    spark = pages.sparkSession
    keep = list(pages.columns) if keep is None else keep
    host, path = split_url(F.col(url))
    held = {c: f"k_{i}" for i, c in enumerate(keep)}
    base = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], host.alias("__host"), path.alias("__path"))
    lengths = sorted({len(r) - r.index("/") for r in rules}) or [1]
    starts = [f"__p{n}" for n in lengths]
    prefixes = [F.when(F.length("__path") >= n, F.substring("__path", 1, n)).alias(p) for n, p in zip(lengths, starts, strict=True)]
    distinct = materialize(base.select("__host", *prefixes).distinct(), "url-keys")
    longest = F.coalesce(*[F.col(p) for p in reversed(starts)], F.lit(""))

    def finder(listed: DataFrame, universe: DataFrame) -> Cascade | None:
        return build_cascade(listed, materialize(universe.distinct(), "universe"))

    def best(fits: Column) -> Column:
        # the keys stand in the order of their hosts' lengths: of equal lengths the first, with the longer host, wins
        return F.aggregate(fits, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))

    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    made = distinct.select(F.explode(rule_keys(F.col("__host"), longest, lengths)).alias("key"))
    by_rule = finder(frame(rules), made)
    listed_rules = frame(rules).join(made, "key", "left_semi")
    allowing = finder(frame([k for k, v in rules.items() if v == "allow"]), listed_rules)
    domains = blocked_domains if isinstance(blocked_domains, DataFrame) else frame(blocked_domains)
    domains = domains.select(lower_ascii(F.col("key")).alias("key"))
    by_domain = finder(domains, distinct.select(F.explode(host_suffixes(F.col("__host"))).alias("key")))
    if by_rule is None or allowing is None:  # too long for constants: the distinct keys meet the list
        said = spark.createDataFrame(list(rules.items()), "key string, __said string")
        hits = distinct.select("__host", *starts, F.posexplode(rule_keys(F.col("__host"), longest, lengths)).alias("pos", "key")).join(said, "key")
        first = hits.groupBy("__host", *starts).agg(F.min_by(F.struct("key", "__said"), F.struct(-F.length("key"), "pos")).alias("__best"))
        first = first.select(F.col("__host").alias("__h"), *[F.col(p).alias(f"{p}b") for p in starts], F.col("__best.key").alias("__rule"), (F.col("__best.__said") == "allow").alias("__allowed"))
        same = F.col("__host") == F.col("__h")
        for p in starts:
            same &= F.col(p).eqNullSafe(F.col(f"{p}b"))
        out = base.select("*", *prefixes).join(first, same, "left")
    else:
        out = base.withColumn("__rule", best(F.filter(rule_keys(F.col("__host"), F.col("__path"), lengths), lambda k: by_rule.contains(k))))
        out = out.withColumn("__allowed", F.when(F.col("__rule").isNotNull(), allowing.contains(F.col("__rule"))))
    if by_domain is None:
        hosts = distinct.select(F.col("__host").alias("__d")).distinct().select("__d", F.explode(host_suffixes(F.col("__d"))).alias("key"))
        listed = hosts.join(domains.distinct(), "key", "left_semi").select("__d").distinct().withColumn("__listed", F.lit(True))
        out, domain = out.join(listed, F.col("__host") == F.col("__d"), "left"), F.coalesce("__listed", F.lit(False))
    else:
        domain = F.exists(host_suffixes(F.col("__host")), lambda h: by_domain.contains(h))
    allow = F.coalesce(F.col("__allowed"), ~domain)
    names = carried(keep, ["host", "path", "rule", "verdict"])
    return out.select(*[F.col(k).alias(names[c]) for c, k in held.items()], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
