"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct shingles of five words (of all its words, if
there are fewer), as 64-bit hashes.  Documents with equal sets form a node, so
exact copies never meet as pairs.  Nodes get ``HASHES`` minima; nodes with
an equal band meet in a bucket.

Verification (after Satuluri and Parthasarathy, 2012): within a bucket all pairs
are compared on batches of their signatures, as arrays; after each batch a
pair goes once the posterior chance that its similarity reaches the threshold,
with a uniform prior, is below ``MISS``.  With t minima compared and m equal, the
posterior of the similarity is Beta(m + 1, t - m + 1), and its mass above the
threshold s is the chance of at most m successes in t + 1 trials of chance s.

Survivors are confirmed on full sets.  Only links between different components
matter, so that is done in two rounds.  First every node tries its ``NEAREST`` most
similar survivors of each bucket, which are joined with their sets.  Then buckets
whose pairs weren't all tried, and which still hold survivors in different
components, get their members' sets and confirm all those pairs in place, one
row of the block at a time; only links come out, at most one for each pair of
components and block.  So no survivor stays unconfirmed unless its ends are
already linked.  Buckets are worked in blocks of ``BLOCK`` by ``BLOCK`` members, and of
``BLOCK_BYTES`` of full sets.  A bucket's nodes learn its size in ``SALTS`` parts, so
that a large bucket is spread there too.

A band has as many rows, up to ``ROWS``, as let a pair at the threshold meet in no
band with chance ``APART`` at most: 24 bands of 6 at 0.85 (1.2e-5), 28 of 5 at 0.80
(1.5e-5).  Such a pair is pruned with chance at most ``MISS`` per batch.

Null texts and texts without words have empty sets and link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import LOWER, UPPER, batches_of, connected_components, materialize, release, small_batches, tidy

SHINGLE, ROWS, BANDS = 5, 6, 24
HASHES = ROWS * BANDS
PERCENT = 85
BATCH, MISS, APART = 16, 1e-4, 2e-5
NEAREST, BLOCK = 3, 1024
BATCH_CHARS = 2_000_000
CACHE_WORDS = 300_000
#: Rows, and bytes of full sets, that a task works on at once; a block's own are bounded alike.
BUCKET_ROWS, BLOCK_BYTES = 8192, 32_000_000
#: Parts in which a bucket's nodes meet its size.
SALTS = 16
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RNG = np.random.Generator(np.random.PCG64(20))
_PLACE = _RNG.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FACTOR = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    if n < 1:
        return _mix((h * _PLACE[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    total = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set: uint32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        part = x[None, lo : lo + 4096]
        for k in range(0, HASHES, 16):
            values = part * _FACTOR[k : k + 16, None]
            values += _ADD[k : k + 16, None]
            np.minimum(out[k : k + 16], values.min(axis=1), out=out[k : k + 16])
    return out


def band_rows(percent: int = PERCENT) -> int:
    """Most rows of a band, up to ROWS, with which a pair at the threshold meets in no band with chance APART at most."""
    s = percent / 100
    return next((n for n in range(ROWS, 1, -1) if (1 - s**n) ** (HASHES // n) <= APART), 1)


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of a signature."""
    bands = HASHES // rows
    n = bands * rows
    return _mix((values[:n].astype(np.uint64).reshape(bands, rows) * _BAND.ravel()[:n].reshape(bands, rows)).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def signature_bytes(values: np.ndarray) -> bytes:
    """16 bits of each minimum, enough to tell equal from unequal."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Fewest equal minima after each batch for a pair to go on."""
    s, out = percent / 100, []
    for t in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(t + 1, m) * s**m * (1 - s) ** (t + 1 - m)
        out.append(m)
    return out


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, least: list[int], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (left, right) of rows: those that survive all batches and have no lower band in common, with their matches."""
    matches = np.zeros(len(left), np.int32)
    for step, low in enumerate(least):
        if not len(left):
            break
        cut = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (sig[left, cut] == sig[right, cut]).sum(axis=1, dtype=np.int32)
        stay = matches >= low
        left, right, matches = left[stay], right[stay], matches[stay]
    if len(left) and band:
        first = np.ones(len(left), bool)
        for lo in range(0, len(left), 100_000):
            a, b = left[lo : lo + 100_000], right[lo : lo + 100_000]
            same = (sig[a, : band * rows] == sig[b, : band * rows]).reshape(len(a), band, rows).all(axis=2).any(axis=1)
            first[lo : lo + 100_000] = ~same
        left, right, matches = left[first], right[first], matches[first]
    return left, right, matches


def block_pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: all within a diagonal block (side 2), else each of side 0 with each of side 1."""
    if (side == 2).all():
        return tuple(x.astype(np.int32) for x in np.triu_indices(len(side), 1))
    a, b = np.flatnonzero(side == 0).astype(np.int32), np.flatnonzero(side == 1).astype(np.int32)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def nearest_pairs(left: np.ndarray, right: np.ndarray, matches: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """Places among the pairs: for each row its k pairs with most matches."""
    one = np.concatenate([left, right])
    other = np.concatenate([right, left])
    place = np.tile(np.arange(len(left)), 2)
    score = np.tile(matches, 2)
    order = np.lexsort((other, -score, one))
    one = one[order]
    start = np.concatenate([[True], one[1:] != one[:-1]])
    rank = np.arange(len(one)) - np.maximum.accumulate(np.where(start, np.arange(len(one)), 0))
    return np.unique(place[order[rank < k]])


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, node (a digest of the set; null if empty), bands, sig of every row; no shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    in_band = band_rows(percent)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, node, bands, sig = [], [], [], []
            for x in batch.column("text").to_pylist():
                s = shingle_set(x)
                n.append(len(s))
                if len(s):
                    v = minima(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(v, in_band).view(np.int64))
                    sig.append(signature_bytes(v))
                else:
                    node.append(None)
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "digest", "n_shingles", "node", "bands", "sig"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidy(run), f"doc_id {id_type}, digest long, n_shingles long, node binary, bands array<long>, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (node, least, digest: the doc_id, or null, and the text's digest of one of its rows)."""
    one = wanted.select(F.col("least").alias("__least"), F.col("digest").alias("__digest")).distinct()
    rows = docs.select(F.col(doc_id).alias("least"), F.col(text).alias("text")).where("text is not null")
    rows = rows.join(one, F.col("least").eqNullSafe(F.col("__least")) & (F.xxhash64("text") == F.col("__digest")), "left_semi").select("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in batches_of(texts, BATCH_CHARS):
                sets = [shingle_set(x) for x in texts[part]]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    small_batches(docs.sparkSession)
    found = rows.mapInArrow(tidy(run), "node binary, shingles array<long>").join(wanted.select("node"), "node", "left_semi")
    return found.dropDuplicates(["node"])


def _blocks(members: DataFrame, parts: Column | None = None) -> DataFrame:
    """Members (key, band, size, node, ...) dealt to the blocks of their bucket: columns i, j, side and a bucket of blocks."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int") if parts is None else parts
    rows = members.withColumn("parts", parts).withColumn("own", F.pmod(F.hash("node"), F.col("parts")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))
    return rows.withColumn("side", F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1)).drop("parts", "own", "o")


def _grouped(table, columns: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(band, rows) of each block in a table of whole blocks."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in columns), strict=True)):
        groups.setdefault(key, []).append(i)
    for key, at in groups.items():
        yield key[0], at


def _try_nearest(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, whole): pairs of nodes to confirm; whole is false for a bucket that had more."""
    least, in_band = least_matches(percent), band_rows(percent)

    def work(table):
        import pyarrow as pa

        a, b = [], []
        node, side = table.column("node").to_pylist(), table.column("side").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        for band, at in _grouped(table, ["band", "key", "i", "j"]):
            rows = np.array(at)
            left, right, matches = survivors(sig[rows], *block_pairs(side[rows]), band, least, in_band)
            if len(left):
                for p in nearest_pairs(left, right, matches):
                    x, y = node[at[left[p]]], node[at[right[p]]]
                    a.append(min(x, y))
                    b.append(max(x, y))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return _dealt(members).applyInArrow(work, "a binary, b binary").distinct()


def _dealt(rows: DataFrame, bytes_of: str | None = None):
    """Blocks in groups of about BUCKET_ROWS rows, or BLOCK_BYTES by a column of sizes; small buckets share a group."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of or F.lit(0)).alias("size")).first()
    groups = max(1, math.ceil(total.n / BUCKET_ROWS), math.ceil((total.size or 0) / BLOCK_BYTES))
    return rows.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).alias("work"))


def _confirm_rest(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members (with label and shingles) that join different labels of a block."""
    least, in_band = least_matches(percent), band_rows(percent)

    def work(table):
        import pyarrow as pa

        a, b = [], []
        node, side, label = table.column("node").to_pylist(), table.column("side").to_numpy(), table.column("label").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        sets = [x.values.to_numpy(zero_copy_only=False) for x in table.column("shingles")]
        for band, at in _grouped(table, ["band", "key", "i", "j"]):
            rows = np.array(at)
            names = {x: k for k, x in enumerate(dict.fromkeys(label[i] for i in at))}
            group = np.array([names[label[i]] for i in at])
            left, right = block_pairs(side[rows])
            apart = group[left] != group[right]
            left, right, _ = survivors(sig[rows], left[apart], right[apart], band, least, in_band)
            parent = list(range(len(names)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            cuts = np.flatnonzero(np.diff(left)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(left)], strict=True):
                if lo == hi:
                    continue
                x = left[lo]
                own = sets[at[x]]
                partners = [y for y in right[lo:hi].tolist() if root(group[y]) != root(group[x])]
                if not partners:
                    continue
                sizes = np.array([len(sets[at[y]]) for y in partners])
                hit = np.isin(np.concatenate([sets[at[y]] for y in partners]), own)
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                for y, c, n in zip(partners, common.tolist(), sizes.tolist(), strict=True):
                    if 100 * c >= percent * (len(own) + n - c) and root(group[x]) != root(group[y]):
                        parent[root(group[x])] = root(group[y])
                        a.append(node[at[x]])
                        b.append(node[at[y]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return _dealt(members, "bytes").applyInArrow(work, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, kept of every row.

    Links join documents with 100 * intersection >= percent * union.  Rows of
    equal sets are one class; component_id is the least doc_id of all classes
    that links reach, kept says that the row has it.  A group whose doc_ids are
    all null has a null component_id; the rows of one of its texts are kept.
    """
    signed = materialize(sign(docs, doc_id, text, percent), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("at"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select("node", F.col("at.doc_id").alias("least"), F.col("at.digest").alias("digest"), "n", "bands", "sig"), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key")).withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS)))
    # at most SALTS rows of a bucket meet for its size, and at most one part of it goes to a task
    parts = banded.groupBy("band", "key", "salt").agg(F.count(F.lit(1)).cast("int").alias("n"))
    shared = parts.groupBy("band", "key").agg(F.sum("n").cast("int").alias("size"), F.collect_list("salt").alias("salts")).where("size > 1").select("band", "key", "size", F.explode("salts").alias("salt"))
    members = materialize(banded.join(shared, ["band", "key", "salt"]), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "least", "digest"), "node")
    wanted = materialize(wanted, "wanted")
    sets = materialize(full_sets(docs, wanted, doc_id, text), "sets")
    with_sig = _blocks(members.join(nodes.select("node", "sig"), "node"))
    pairs = materialize(_try_nearest(with_sig, percent), "pairs")
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    links = materialize(pairs.join(one, "a").join(two, "b").where(100 * common >= percent * union).select("a", "b"), "links")
    release(pairs, wanted)
    # a bucket of up to NEAREST + 1 nodes has tried all its pairs
    labels = materialize(connected_components(links), "labels")
    large = members.where(F.col("size") > NEAREST + 1).join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = large.join(sets.select("node", (F.size("shingles").cast("long") * 8).alias("bytes")), "node")
    mixed = large.groupBy("band", "key").agg((F.min("label") != F.max("label")).alias("mixed"), F.sum("bytes").alias("whole")).where("mixed")
    mixed = mixed.select("band", "key", "whole", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = _blocks(large.join(mixed, ["band", "key", "salt"]), F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("whole") / BLOCK_BYTES))).cast("int"))
    rest = materialize(rest.drop("whole"), "rest")
    if rest.limit(1).count():
        more = _confirm_rest(rest.join(nodes.select("node", "sig"), "node").join(sets, "node"), percent)
        more = materialize(more, "links")
        links = links.unionByName(more)
        labels = materialize(connected_components(links), "labels")
    release(members, sets, rest)
    joined = nodes.select("node", "least", "digest", "n").join(labels, "node", "left")
    reached = joined.where("component is not null")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"), F.min("digest").alias("first"))
    named = reached.join(least, "component").select("node", "component_id", "first").unionByName(joined.where("component is null and n > 1").select("node", F.col("least").alias("component_id"), F.col("digest").alias("first")))
    out = signed.select("doc_id", "digest", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    # without any doc_id, the group's first text stays
    kept = F.col("doc_id").eqNullSafe(component) & (F.col("doc_id").isNotNull() | F.col("first").isNull() | (F.col("digest") == F.col("first")))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each group; repeated rows are one."""
    kept = near_duplicates(docs, doc_id, text, percent).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(kept.select(F.col("doc_id").alias("__d"), F.col("digest").alias("__t"), "n"), "kept")
    keyed = docs.withColumn("__digest", F.xxhash64(F.col(text)))
    out = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__digest") == F.col("__t")), "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates([doc_id, "__digest"])
    return out.drop("__digest")
