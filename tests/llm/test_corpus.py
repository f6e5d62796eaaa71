import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import embedding_dedup as ed
from docweave.llm import minhash_dedup as md
from docweave.llm import mixture as mx
from docweave.llm.common import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want


def _shingles(text):
    words = (text or "").encode().translate(md._LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _copies():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for i in range(90):  # a large group around one text
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(30):
        w = [word() for _ in range(rng.randrange(1, 60))]
        rows += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1]), "\n".join(w + w[:1])]
    rows += [None, "", " \t", "a b", "A  b", "b a", "x", "x " * 3000]
    return [(i * 3 % 1009, x) for i, x in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rows = _copies()
    docs = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, kept int")
    sets = {i: _shingles(x) for i, x in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: r for r in md.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i] and got[i].kept == (want[i] == i), i
    kept = md.keep_one(docs.unionByName(docs.limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert md.near_duplicates(none).count() == 0
    same = spark.createDataFrame([(5, "a b c")] * 3 + [(4, "a b c"), (None, "a b c"), (5, "other words")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in md.near_duplicates(same).collect()) == [(-1, 4), (4, 4), (5, 4), (5, 4), (5, 4), (5, 5)]


def test_pruning_keeps_pairs_at_the_threshold():
    least = md.least_matches()
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        hits = np.cumsum(rng.random(md.HASHES) < 0.85)[md.BATCH - 1 :: md.BATCH]
        lost += any(h < m for h, m in zip(hits, least))
    assert lost <= 4
    assert all(a < b for a, b in zip(least, least[1:]))


def test_near_copies_without_doc_ids_are_linked(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a + " more"), (None, a.upper()), (7, b), (None, b + " more"), (None, c), (None, d), (None, d), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = md.keep_one(docs).collect()
    texts = [r.text for r in got]
    assert len(got) == 6 and sum((x or "").lower().startswith("a0") for x in texts) == 1
    assert (7, b) in [tuple(r) for r in got] and b + " more" not in texts and texts.count(c) == texts.count(d) == texts.count(None) == texts.count("") == 1
    out = md.near_duplicates(docs).collect()
    assert len(out) == len(rows) and sorted(str(r.component_id) for r in out) == ["7"] * 2 + ["None"] * 8


def test_pipeline_links_near_copies_at_eighty_percent(spark):
    import corpus_pipeline as cp

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(40):
        w = [word() for _ in range(24 + i)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] + [word()] * (1 + i % 10)))]
    sets = {i: _shingles(x) for i, x in rows}
    share = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert sum(80 <= x < 85 for x in share.values()) >= 5 and any(70 < x < 80 for x in share.values())
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for percent, got in ((80, cp.near_dedup(spark, docs, "")), (85, md.keep_one(docs, percent=85))):
        want = components(sets, [p for p, x in share.items() if x >= percent])
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in sets if want[i] == i), percent


@pytest.mark.parametrize("percent, rows", [(80, 5), (85, 6), (95, 6)])
def test_bands_miss_few_pairs_at_the_threshold(percent, rows):
    assert md.band_rows(percent) == rows and len(md.band_keys(np.arange(md.HASHES, dtype=np.uint32), rows)) == md.HASHES // rows
    assert (1 - (percent / 100) ** rows) ** (md.HASHES // rows) <= 2e-5


def test_links_of_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(320, 16)) * np.repeat(rng.choice([0.01, 0.08, 0.2], 40), 8)[:, None]
    x[5] = x[4]
    rows = [(i, [float(v) for v in x[i]], int(i // 160)) for i in range(320)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, rows[0][1], None), (404, [None, *rows[0][1][1:]], 0), (405, [float("inf"), *rows[0][1][1:]], 0), (406, rows[0][1][:8], 0)]
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(320)[:, None] // 160 == np.arange(320) // 160)
    np.fill_diagonal(near, False)
    want = components(range(320), np.argwhere(np.triu(near)).tolist())
    assert near.sum() > 100
    links = sum(got[i].n_links for i in range(320))
    assert links >= 0.97 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(320))
    assert sum(got[i].component_id == want[i] for i in range(320)) >= 316
    for i in range(400, 407):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(empty).count() == 0


def test_recall_over_the_table(spark):
    """Recall against brute force where the grid has many cells and most vectors are far apart."""
    rng = np.random.default_rng(7)
    n, width, families = 40_000, 32, 2500
    x = rng.normal(size=(n, width))
    x[: 4 * families] = np.repeat(x[:families], 4, axis=0) + rng.normal(size=(4 * families, width)) * np.repeat(rng.choice([0.05, 0.11, 0.16], families), 4)[:, None]
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(n)], "vec_id long, embedding array<float>, label int")
    got = np.zeros(n, np.int64)
    for r in ed.near_duplicates(rows).collect():
        got[r.vec_id] = r.n_links
    true = found = 0
    for label in (0, 1):
        own = x[label::2].astype(np.float64)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        for lo in range(0, len(own), 2000):
            links = (own[lo : lo + 2000] @ own.T >= 0.98).sum(axis=1) - 1
            here = got[label::2][lo : lo + 2000]
            assert (here <= links).all()
            true += int(links.sum())
            found += int(here.sum())
    assert true > 5000 and 0.9 * true <= found <= true, (found, true)


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.random(6), rng.random(5)
        a[0] = b[0] = 0
        got = ed.traverse(a, b, 0.8)
        far = [a[i] ** 2 + b[j] ** 2 for i, j in got]
        assert far == sorted(far)
        assert set(got) == {(i, j) for i in range(6) for j in range(5) if a[i] ** 2 + b[j] ** 2 <= 0.64}


@pytest.mark.parametrize("n", [1, 2, 5, 64, 97])
def test_shuffle_is_a_permutation(spark, n):
    got = [r.x for r in spark.range(n).select(mx.permuted(F.col("id"), F.lit(n), F.lit(3).cast("long")).alias("x")).collect()]
    assert sorted(got) == list(range(n))


def _water(sizes, weights, epochs=3):
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > epochs * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choices(["a", "b", "c", "d", "é", "Z", None], [60, 10, 10, 2, 5, 5, 3])[0]) for i in range(600)]
    rows += [(700, None, "empty"), (1, rows[1][1], rows[1][2]), (None, "x y", "a"), (701, "w " * 20_000, "b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = mx.taken_words(*mx.mix(docs)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mx.taken_words(*mx.mix(docs)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, x, s in rows:
        sizes[s] = sizes.get(s, 0) + len((x or "").split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    want = _water(sizes, weights)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - want[s]) < 1e-6 * max(want[s], 1) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.03 * want[s] + 3 * mx.BLOCK
    assert all(r.taken <= 3 * r.size for r in got)
    empty = docs.limit(0)
    assert mx.taken_words(*mx.mix(empty)).count() == 0


def test_mix_equals_plain_python(spark):
    """Shares, draws, permutations and blocks by loops; the hashes themselves are Spark's."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, shard_slots, seed, epochs = 8, 64, 9, 3
    named, spans = mx.mix(docs, block=block, shard_slots=shard_slots, seed=seed, epochs=epochs)
    placed = named.select("doc_id", "source", "n", "chunk", "rn", "offset", "size").collect()
    got = sorted((r.n, r.shard, r.epoch, r.block, r.chunk, r.rn, r.start, r.stop) for r in spans.collect())
    hashes = {}

    def xx(*args):
        """xxhash64 of values, a batch of them at a time."""
        return hashes[args]

    def learn(frame):
        for r in frame.collect():
            hashes[tuple(r)[:-1]] = r[-1]

    # documents of a source lie end to end, in the order of chunk and row
    sizes = {}
    for r in sorted(placed, key=lambda r: (r.n, r.chunk, r.rn)):
        assert r.offset == sizes.get(r.n, 0)
        sizes[r.n] = r.offset + r.size
    names = {r.n: r.source for r in placed}
    assert [names[n] for n in sorted(names)] == ["a", "b", "c", None]
    target = _water({n: sizes[n] for n in sizes}, {n: (n - 1) % 3 + 1 for n in sizes}, epochs)
    blocks = {n: -(-sizes[n] // block) for n in sizes}
    expected = {n: target[n] * blocks[n] / sizes[n] for n in sizes}
    total = int(np.ceil(sum(expected.values()) - 1e-9))
    share = {n: expected[n] / sum(expected.values()) for n in sizes}
    shards = -(-total // shard_slots)
    learn(spark.range(shards).crossJoin(spark.range(1, 9).withColumnRenamed("id", "j")).select(F.lit(seed).alias("s"), "id", F.col("j").cast("int"), F.xxhash64(F.lit(seed), "id", F.col("j").cast("long"))))
    slots = {n: 0 for n in sizes}
    taken = []
    for shard in range(shards):
        m = min(shard_slots, total - shard * shard_slots)
        count = {n: int(np.floor(share[n] * m)) for n in sizes}
        rest = {n: share[n] * m - count[n] for n in sizes}
        upto = np.cumsum([rest[n] for n in sorted(rest)]) / sum(rest.values())
        for j in range(1, m - sum(count.values()) + 1):
            u = (xx(seed, shard, j) % (1 << 40)) / (1 << 40)
            count[sorted(rest)[int(np.searchsorted(upto, u, side="right"))]] += 1
        for n in sorted(sizes):
            taken += [(n, shard, k) for k in range(slots[n], slots[n] + count[n])]
            slots[n] += count[n]
    taken = [(n, shard, k // blocks[n], k % blocks[n]) for n, shard, k in taken if k // blocks[n] < epochs]
    # one draw and one partner per round, epoch and source
    learn(spark.createDataFrame([(seed, n, e) for n in sizes for e in range(epochs)], "s int, n long, e long").select("s", "n", "e", F.xxhash64("s", "n", "e")))
    keys = {(n, e): xx(seed, n, e) for n in sizes for e in range(epochs)}
    grid = spark.createDataFrame([(k, i) for k in keys.values() for i in range(1, mx.ROUNDS + 1)], "k long, i int")
    learn(grid.select("k", "i", F.xxhash64("k", "i")))
    most = max(blocks.values())
    learn(grid.crossJoin(spark.range(most).withColumnRenamed("id", "x")).select("k", "i", "x", F.xxhash64("k", "i", "x")))
    want = []
    spread = {n: [r for r in placed if r.n == n and r.size] for n in sizes}
    for n, shard, epoch, x in taken:
        for i in range(1, mx.ROUNDS + 1):
            partner = (xx(keys[n, epoch], i) % blocks[n] - x) % blocks[n]
            if xx(keys[n, epoch], i, max(x, partner)) % 2 == 1:
                x = partner
        for r in spread[n]:
            start, stop = max(0, x * block - r.offset), min(r.size, (x + 1) * block - r.offset)
            if start < stop:
                want.append((n, shard, epoch, x, r.chunk, r.rn, start, stop))
    assert got == sorted(want)


def test_sums_of_slots_by_ranges(spark):
    rows = [(s, n, (s * 7 + n) % 5) for s in range(300) for n in (1, 2, 3) if (s + n) % 4]
    got = {(r.shard, r.n): r.first for r in mx.first_slots(spark.createDataFrame(rows, "shard long, n long, count long"), together=16).collect()}
    so_far = {}
    for s, n, c in sorted(rows):
        assert got[s, n] == so_far.get(n, 0)
        so_far[n] = so_far.get(n, 0) + c
    assert len(got) == len(rows)


def test_mixed_rows_are_parts_of_their_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{k}" for k in range(i * 17 % 300)), f"s{i % 3}", "en") for i in range(60)], "doc_id long, text string, source string, lang string")
    rows, spans = mx.mix(docs)
    docs = docs.unionByName(docs.where("doc_id = 7"))
    rows, spans = mx.mix(docs)
    out = mx.mixed_rows(docs, rows, spans).select("doc_id", "text").collect()
    whole = {r.doc_id: r.text.split() for r in docs.collect()}
    for r in out:
        assert set(r.text.split()) <= set(whole[r.doc_id]) and r.text
    took: dict[int, int] = {}
    for r in mx.taken_words(rows, spans).collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    for i, n in took.items():
        assert sum(len(r.text.split()) for r in out if r.doc_id == i) == n


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.quality_classifier(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good
    out = cp.run(spark, sf)
    rows = out.collect()
    assert rows and all(r.parity and r.round_trip for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_stages_take_odd_rows_and_clashing_columns(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.orderBy("doc_id").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "word " * 50_000, None, None, 250_000), (None, "a b c", "xx", None, 5)], docs.schema)
    odd = few.unionByName(few.limit(3)).unionByName(odd).withColumns({c: F.lit(i) for i, c in enumerate(["score", "kept", "ids", "digest", "size", "n", "in_kept", "k_0"])})
    for name, stage in cp.STAGES:
        got, none = stage(spark, odd, sf), stage(spark, odd.limit(0), sf)
        assert none.count() == 0 and none.columns == got.columns, name
        if name != "sentencepiece":
            assert got.columns == odd.columns, name
            rows = got.collect()
            assert len(rows) > 10 and all((r.score, r.kept, r.in_kept, r.k_0) == (0, 1, 6, 7) for r in rows), name
        else:
            assert got.count() == odd.count()


def test_pipeline_stages_equal_plain_python(spark, sf):
    import corpus_pipeline as cp
    import sentencepiece

    from docweave.llm.common import materialize
    from docweave.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = materialize(cp.quality_classifier(spark, docs, sf), "t1")
    two = materialize(cp.quality_rule_filter(spark, one, sf), "t2")
    texts = {r.doc_id: r.text for r in two.collect()}
    for x in texts.values():
        words = x.split()
        assert len(words) >= 50 and sum(any(c in "#*$%&|<>" for c in w) for w in words) <= 0.35 * len(words)
    three = materialize(cp.near_dedup(spark, two, sf), "t3")
    sets = {i: _shingles(x) for i, x in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in three.collect()} == {i for i, c in components(sets, links).items() if i == c}
    kept = {r.doc_id: (r.text, r.source) for r in three.collect()}
    four = materialize(cp.mix_sources(spark, three, sf), "t4")
    sizes, taken = {}, {}
    for x, source in kept.values():
        sizes[source] = sizes.get(source, 0) + len(x.split())
    rows = four.collect()
    for r in rows:
        assert r.text in kept[r.doc_id][0] or set(r.text.split()) <= set(kept[r.doc_id][0].split())
        assert r.source == kept[r.doc_id][1] and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    want = _water(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    for s in sizes:
        assert abs(taken.get(s, 0) - want[s]) <= 0.05 * want[s] + 3 * mx.BLOCK
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    five = cp.encode(spark, four, sf).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in five) == sorted((r.doc_id, model.encode(r.text)) for r in rows)
