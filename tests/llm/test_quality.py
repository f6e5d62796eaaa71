import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import line_crf, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_plain_python(spark):
    texts = [None, "", " \n\t", "a b c a b c a b c", "one\ntwo\none\n\n \none", "x " * 60, " ".join(f"w{i}" for i in range(70)) + " # *| é日", "a b c d\na b c d\nz", "\x0b\x0c a\xa0b \x85c"]
    texts += ["word " * 200_000 + "x y z"]
    docs = spark.createDataFrame([(i, x, "en" if i % 2 else None, "q", i) for i, x in enumerate(texts)], "doc_id long, text string, lang string, kept string, classes int")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(r.in_kept == "q" and r.classes == i for i, r in rows.items())
    for i, x in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(x), repr(x)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0), keep=["doc_id"]).count() == 0


def test_whole_table_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs, keep=["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


def test_divergence(spark):
    from pyspark.sql import functions as F

    def plain(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        return sum(0.5 * a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * math.log2(b / c) for b, c in zip(q, m) if b)

    rows = [([1, 2, 3], [3, 2, 1]), ([0, 5, 0], [1, 0, 1]), ([4, 4, 4], [4, 4, 4])]
    got = spark.createDataFrame([(a, b) for a, b in rows], "a array<long>, b array<long>").select(quality_rules.jsd(F.col("a"), F.col("b")).alias("d")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert abs(math.sqrt(max(plain(a, b), 0)) - r.d) < 1e-7


def test_junk_goes_and_prose_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality_rules.judge(docs, keep=["doc_id"]).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert all(r.kept for r in good)
    assert not bad or sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_capital_words_count_at_any_share(spark):
    def count(text):
        return sum(sum(c.isupper() for c in w) > 1 and not any(c.islower() or c in "#*$%&|<>0123456789" for c in w) for w in WORD.findall(text))

    texts = ["plain words " * 30 + "NATO", "An I A b. " * 20 + "A.B. É-É O'Brien X1Y A#B McD aBC ABc", "\n".join(["planet"] * 78 + ["UN"] * 22), "A B", "ǅ ÀÉ", "ABC " * 30]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.k_0: r.forms[2] for r in quality_rules.text_features(docs, ["doc_id"]).collect()}
    assert got == {i: count(x) for i, x in enumerate(texts)} and got[0] == 1 and got[2] == 22


def test_capital_words_below_a_tenth_of_the_letters_reject(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    prose = [" ".join(word() for _ in range(200)) for _ in range(40)]
    odd = " ".join("UN" if i % 25 in (0, 4, 8, 12, 16, 20) else word() for i in range(200))
    docs = spark.createDataFrame([(i, x, "xx") for i, x in enumerate([*prose, odd])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, keep=["doc_id"]).collect()}
    assert all(got[i].kept for i in range(40))
    assert got[40].class_jsd <= quality_rules.MAX_CLASS_JSD and got[40].form_jsd > quality_rules.MAX_FORM_JSD and not got[40].kept


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, moves, counts = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 0, 1, 3, 1])
    bad, pairs, logz = line_crf.forward_backward(scores, moves, counts)
    at, want, total, want_pairs = 0, [], 0.0, np.zeros((2, 2))
    for n in counts:
        if not n:
            continue
        weights = {y: math.exp(sum(scores[at + i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        total += math.log(z)
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(bad, want) and np.allclose(pairs, want_pairs) and abs(total - logz) < 1e-9


def plain_features(text):
    """The features of a text's lines, one line and one character at a time."""
    import unicodedata

    def own(line, seen):
        kinds = {k: 0 for k in ("letter", "upper", "digit", "symbol", "shout", "other")}
        for c in line:
            k = unicodedata.category(c)
            if c in "#*$%&|<>":
                kinds["symbol"] += 1
            elif c in "!?":
                kinds["shout"] += 1
            elif c in "\t\n\x0b\x0c\r" or k == "Zs" or k[0] == "P":
                pass
            else:
                kinds["letter" if ord(c) >= 0x2FFF else "upper" if k == "Lu" else "letter" if k[0] == "L" else "digit" if k == "Nd" else "other"] += 1
        w = line.split()
        nw, letters = max(len(w), 1), max(kinds["letter"] + kinds["upper"], 1)
        return [
            1.0, min(kinds["symbol"] / nw, 3), kinds["upper"] / letters if letters > 8 else 0, min(kinds["shout"] / nw, 3), kinds["digit"] / len(line), kinds["other"] / len(line),
            min(len(line) / nw / 10, 3), math.log1p(nw) / 5, 1 - len(set(w)) / nw if nw >= 8 else 0, sum(a == b for a, b in zip(w, w[1:])) / nw, float(line in seen),
        ]

    lines = [s for s in text.split("\n") if s.strip()]
    rows = [own(s, lines[:i]) for i, s in enumerate(lines)]
    none = [0.0] * line_crf.N_FEATURES
    return [rows[i] + (rows[i - 1] if i else none) + (rows[i + 1] if i + 1 < len(rows) else none) for i in range(len(rows))], [len(s) for s in lines]


def plain_score(model, text):
    """Forward-backward of one document by loops over its lines, then the curve."""
    rows, chars = plain_features(text)
    local = [(1.0, math.exp(sum(a * b for a, b in zip(r, model.weights)))) for r in rows]
    move = [[math.exp(model.moves[a][b]) for b in (0, 1)] for a in (0, 1)]
    n = len(rows)
    ahead = []
    for t in range(n):
        a = [local[t][y] * (sum(ahead[-1][x] * move[x][y] for x in (0, 1)) if t else 1.0) for y in (0, 1)]
        ahead.append([v / sum(a) for v in a])
    back = [[1.0, 1.0] for _ in range(n)]
    for t in range(n - 2, -1, -1):
        b = [sum(move[x][y] * local[t + 1][y] * back[t + 1][y] for y in (0, 1)) for x in (0, 1)]
        back[t] = [v / sum(b) for v in b]
    bad = [ahead[t][1] * back[t][1] / sum(ahead[t][y] * back[t][y] for y in (0, 1)) for t in range(n)]
    share = sum(b * c for b, c in zip(bad, chars)) / sum(chars) if n else 0.0
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * share)))


def test_scores_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = line_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in line_crf.score(docs, model, keep=["doc_id"]).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9, r.doc_id
    for x in ("", "\n \n", "A! b? #1\n\nA! b? #1\n\u4e2d\u6587 \U0001f389 x\u0301", "One\ttwo THREE FOUR FIVE %% x x x y z q\n" * 40):
        assert abs(model.scores([x])[0] - plain_score(model, x)) < 1e-9, repr(x)


def test_training_rows_are_chosen_alike_whatever_their_order(spark):
    rows = [(i % 30, f"good words number {i} here\nmore of them" if i % 3 else "%%% &&& ***\n### $$$ %%%" + "!" * (i % 7)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)] * 2 + [(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    one, two = (line_crf.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[::-1]))
    assert np.array_equal(one.weights, two.weights) and one.curve == two.curve
    assert line_crf.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_chars=10) is None


def test_held_out_accuracy(spark, sf):
    from pathlib import Path

    sf = str(Path(sf).parent / "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = line_crf.score(docs, line_crf.train(docs, labels), keep=["doc_id"]).withColumn("out", line_crf.held_out(F.col("doc_id")))
    got = scored.where("out").join(labels, "doc_id").collect()
    right = sum((r.score >= line_crf.THRESHOLD) == (r.quality == 1) for r in got)
    assert len(got) > 40 and right / len(got) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "\n\n", 0.3), (3, "\n\n", 0.3), (4, "x " * 50_000, 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.train(docs, none) is None
    assert sorted((r.doc_id, r.score, r.in_score) for r in line_crf.score(docs, None).collect()) == [(i, 0.5, s) for i, s in ((1, 0.1), (2, 0.2), (3, 0.3), (3, 0.3), (4, 0.4))]
    model = line_crf.fit(["good words here\nmore of them"] * 5 + ["%%% &&& ***\n### $$$ %%%"] * 5, [1] * 5 + [0] * 5)
    got = {r.doc_id: r.score for r in line_crf.score(docs, model, keep=["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] > 0.3
    assert model.scores(["fine words"])[0] > 0.5 > model.scores(["%%% *** &&&"])[0]
    assert line_crf.score(docs.limit(0), model, keep=["doc_id"]).count() == 0
