"""Layout: words to lines, groups of lines, and the boxes of extracted fields.

Segments are rows (doc_id, page, ord, seg_id, text, x, y, width, height).
Groups come from three hops to the next segment of the column; candidates for a
field come from equi-joins on tokens and trigrams with their document
frequencies; only the short list meets the string ratio.  Fields that take their
boxes one after another are a fold per document, over the same index.
"""

from __future__ import annotations

import collections
import difflib
import functools
import heapq
import itertools
import re

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import FOLD, missing, normalize_layout, sequence_ratio, trigrams

MAX_FUZZY = 50
ACCEPT_EVIDENCE, ACCEPT = 0.7, 0.48
_FOLDED = str.maketrans(*FOLD)
_MARKS = re.compile("[\u0300-\u036f]+")


def union_box(prefix: str = "") -> list[Column]:
    """the box around a group's boxes, as aggregates x, y, width, height of six places."""
    x, y, w, h = (F.col(f"{prefix}{c}") for c in ("x", "y", "width", "height"))
    return [F.round(F.min(x), 6).alias("x"), F.round(F.min(y), 6).alias("y"), F.round(F.max(x + w) - F.min(x), 6).alias("width"), F.round(F.max(y + h) - F.min(y), 6).alias("height")]


def normalized_box(vertices: Column, width: Column, height: Column, normalized: Column) -> Column:
    """the box of corner points, in parts of the page, cut to it; null without points or page size."""
    xs = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0.0)) / F.when(normalized, F.lit(1.0)).otherwise(width))
    ys = F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0.0)) / F.when(normalized, F.lit(1.0)).otherwise(height))
    left, top = F.greatest(F.array_min(xs), F.lit(0.0)), F.greatest(F.array_min(ys), F.lit(0.0))
    right, bottom = F.least(F.array_max(xs), F.lit(1.0)), F.least(F.array_max(ys), F.lit(1.0))
    box = F.struct(F.round(left, 6).alias("x"), F.round(top, 6).alias("y"), F.round(F.greatest(right - left, F.lit(0.0)), 6).alias("width"), F.round(F.greatest(bottom - top, F.lit(0.0)), 6).alias("height"))
    usable = (F.size(vertices) > 0) & (normalized | ((width > 0) & (height > 0)))
    return F.when(usable, box)


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, para, word, text, break_type, x, y, width, height) as lines.

    A word that ends a line starts a new island behind it; lines are numbered
    per page and take the box around their words.
    """
    order = Window.partitionBy("doc_id", "page", "para").orderBy("word")
    ends = F.col("break_type").isin("EOL_SURE_SPACE", "LINE_BREAK").cast("int")
    have = words.where(missing(F.col("text")).isNotNull())
    island = have.withColumn("island", F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = island.groupBy("doc_id", "page", "para", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"), *union_box())
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("para", "island")) - 1
    return lines.where("x is not null").withColumn("ord", number).withColumn("seg_id", F.concat(F.lit("p"), "page", F.lit("-s"), "ord")).drop("para", "island")


def anchored_text(text: Column, segments: Column) -> Column:
    """The slices of a text that an anchor names (array of start, end), one behind the other."""
    return F.array_join(F.transform(segments, lambda s: F.substring(text, F.coalesce(s["start"], F.lit(0)) + 1, s["end"] - F.coalesce(s["start"], F.lit(0)))), "")


def next_in_column(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_id, next_id): for each segment the first one behind it, in page order, that shares its column."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x", "ord")
    placed = segments.where("x is not null and y is not null").withColumn("place", F.row_number().over(order))
    a = placed.select("doc_id", "page", F.col("seg_id").alias("a_id"), F.col("place").alias("a_place"), F.col("x").alias("ax"), (F.col("x") + F.col("width")).alias("ar"), (F.col("y") + F.col("height")).alias("ab"))
    b = placed.select("doc_id", "page", "seg_id", "place", "x", (F.col("x") + F.col("width")).alias("r"), "y")
    gap = F.col("y") - F.col("ab")
    near = gap.between(-0.01, 0.08) & (F.abs(F.col("ax") - F.col("x")) <= 0.18) & (F.least("ar", "r") - F.greatest("ax", "x") >= -0.02)
    found = a.join(b, ["doc_id", "page"]).where((F.col("place") > F.col("a_place")) & near)
    return found.groupBy("doc_id", "a_id").agg(F.min_by("seg_id", "place").alias("next_id")).select("doc_id", F.col("a_id").alias("seg_id"), "next_id")


def segment_groups(segments: DataFrame, longest: int = 4) -> DataFrame:
    """(doc_id, g_ord, members, text, page): single segments, and each with up to three that follow in its column.

    Singles keep the order of segments; groups follow in page order.
    """
    nexts = next_in_column(segments)
    single = segments.select("doc_id", "page", "ord", F.array("seg_id").alias("members"), F.col("text").alias("text"), F.col("seg_id").alias("last"), F.lit(1).alias("n"), "y", "x")
    texts = segments.select("doc_id", F.col("seg_id").alias("next_id"), F.col("text").alias("next_text"))
    hop = nexts.join(texts, ["doc_id", "next_id"]).select("doc_id", F.col("seg_id").alias("last"), "next_id", "next_text")
    out, current = single, single
    for n in range(2, longest + 1):
        current = current.join(hop, ["doc_id", "last"]).select("doc_id", "page", "ord", F.array_append("members", F.col("next_id")).alias("members"), F.concat_ws("\n", "text", "next_text").alias("text"), F.col("next_id").alias("last"), F.lit(n).alias("n"), "y", "x")
        out = out.unionByName(current)
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("n") == 1, 0).otherwise(1), F.when(F.col("n") == 1, F.col("ord")), "page", "y", "x", "ord", "n")
    return out.withColumn("g_ord", F.row_number().over(order) - 1).select("doc_id", "g_ord", "members", "text", "page", "n")


def nearest_segments(segments: DataFrame, matched: DataFrame, k: int = 6) -> DataFrame:
    """for each matched segment (doc_id, seg_id) the k segments of its page whose middles are nearest in height, itself included."""
    mid = segments.withColumn("mid", F.col("y") + F.col("height") / 2)
    at = matched.join(mid, ["doc_id", "seg_id"]).select("doc_id", F.col("seg_id").alias("at_id"), "page", F.col("mid").alias("at_mid"))
    near = mid.join(at, ["doc_id", "page"]).withColumn("dy", F.round(F.abs(F.col("mid") - F.col("at_mid")), 6))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "at_id").orderBy("dy", "ord")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "at_id", "seg_id", "rank", "dy", (F.col("seg_id") == F.col("at_id")).alias("is_match"))


def cheap_similarity(qt: Column, qg: Column, ct: Column, cg: Column) -> Column:
    """F17."""
    part = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return 0.72 * part(qt, ct) + 0.28 * part(qg, cg)


def contains_score(needle: Column, hay: Column) -> Column:
    """F15 without the ratio: containment either way, else null."""
    cover = lambda a, b: F.least(F.lit(1.0), F.length(a) / F.greatest(F.length(b), F.lit(1)))
    return F.when((needle == "") | (hay == ""), 0.0).when(hay.contains(needle), 0.82 + 0.18 * cover(needle, hay)).when(needle.contains(hay) & (F.length(hay) >= 4), 0.72 + 0.18 * cover(hay, needle))


def match_score(needle: Column, hay: Column, needle_tokens: Column, hay_tokens: Column) -> Column:
    """F15."""
    overlap = F.size(F.array_intersect(needle_tokens, hay_tokens)) / F.greatest(F.size(needle_tokens), F.lit(1))
    return F.coalesce(contains_score(needle, hay), F.greatest(sequence_ratio(needle, hay) * 0.78, overlap * 0.84))


def likely_score(needle: Column, hay: Column, needle_tokens: Column, hay_tokens: Column, least: float) -> Column:
    """F15 where it is ``least`` or more when rounded; pairs that can't reach that by their lengths get no string ratio."""
    a, b = F.length(needle), F.length(hay)
    overlap = F.size(F.array_intersect(needle_tokens, hay_tokens)) / F.greatest(F.size(needle_tokens), F.lit(1)) * 0.84
    held = contains_score(needle, hay)
    bound = 2 * F.least(a, b) / (a + b) * 0.78 + 1e-9
    open_ = held.isNull() & (bound >= least - 1e-4) & (bound >= overlap)
    ratio = F.when(open_, sequence_ratio(F.when(open_, needle), F.when(open_, hay)) * 0.78)
    return F.coalesce(held, F.greatest(ratio, overlap))


def indexed(groups: DataFrame) -> DataFrame:
    """Groups with the tokens and trigrams of their normal form."""
    return groups.withColumn("g_tokens", F.array_distinct(F.split("g_norm", " "))).withColumn("g_grams", trigrams(F.col("g_norm")))


def containments(asked: DataFrame, known: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, t_id, g_ord) of texts (doc_id, t_id, t_norm) and groups (doc_id, g_ord, g_norm) where the text is in the group, or the group, of 4 characters or more, in the text.

    What holds a string holds the string's rarest window of ``size`` characters, so
    that windows bring the pairs to compare; strings too short for one meet all
    others of their document.
    """

    def windows(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size))))

    def held(inner: DataFrame, outer: DataFrame, least: int) -> DataFrame:
        """(doc_id, i, o): which inner (doc_id, i, s) of ``least`` characters or more stand in which outer (doc_id, o, s)."""
        # none stands in shorter ones
        longest = outer.groupBy("doc_id").agg(F.max(F.length("s")).alias("most"))
        inner = inner.where(F.length("s") >= least).join(longest, "doc_id").where(F.length("s") <= F.col("most")).drop("most")
        long = inner.where(F.length("s") >= size).select("doc_id", "i", "s", F.explode(windows(F.col("s"))).alias("w"))
        # only windows that some inner string has are kept of the outer ones
        posted = outer.where(F.length("s") >= size).select("doc_id", "o", F.explode(windows(F.col("s"))).alias("w")).join(long.select("doc_id", "w").distinct(), ["doc_id", "w"], "left_semi")
        df = posted.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("df"))
        # a string with a window that no outer string has stands in none
        rarest = long.join(df, ["doc_id", "w"], "left").groupBy("doc_id", "i", "s").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("r")).where("r.df > 0").select("doc_id", "i", "s", "r.w")
        whole = outer.select("doc_id", "o", F.col("s").alias("o_s"))
        found = rarest.join(posted, ["doc_id", "w"]).join(whole, ["doc_id", "o"]).where(F.col("o_s").contains(F.col("s")))
        short = inner.where(F.length("s") < size).join(whole, "doc_id").where(F.col("o_s").contains(F.col("s")))
        return found.select("doc_id", "i", "o").unionByName(short.select("doc_id", "i", "o"))

    t, g = asked.select("doc_id", F.col("t_id").alias("i"), F.col("t_norm").alias("s")), known.select("doc_id", F.col("g_ord").alias("i"), F.col("g_norm").alias("s"))
    inside = held(t, g.withColumnRenamed("i", "o"), 1).select("doc_id", F.col("i").alias("t_id"), F.col("o").alias("g_ord"))
    around = held(g, t.withColumnRenamed("i", "o"), 4).select("doc_id", F.col("o").alias("t_id"), F.col("i").alias("g_ord"))
    return inside.unionByName(around).distinct()


def shortlist(texts: DataFrame, groups: DataFrame, limit: int = MAX_FUZZY) -> DataFrame:
    """F16: (doc_id, t_id, g_ord, exact): groups worth comparing with each text.

    texts: doc_id, t_id, text.  Exact containment always counts; the four rarest
    known tokens bring their groups, or the best single lines theirs; where few
    were found, groups with the most rare trigrams join in.  The best ``limit``
    by the cheap score stay, and all exact ones.  Exact rows depend on no others:
    who asks for them alone has a plan without the rest.
    """
    # many joins read both: kept, in memory or on disk, they aren't made again for each
    own = texts.withColumn("t_norm", normalize_layout(F.col("text"))).where("t_norm <> ''").drop("text").persist(StorageLevel.MEMORY_AND_DISK)
    asked = own.withColumn("t_tokens", F.array_distinct(F.split("t_norm", " "))).withColumn("t_grams", trigrams(F.col("t_norm")))
    known = indexed(groups.withColumn("g_norm", normalize_layout(F.col("text"))).select("doc_id", "g_ord", "members", "n", "g_norm").persist(StorageLevel.MEMORY_AND_DISK))
    total = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"))
    exact = containments(asked.select("doc_id", "t_id", "t_norm"), known.select("doc_id", "g_ord", "g_norm"))
    postings = known.select("doc_id", "g_ord", F.explode("g_tokens").alias("token"))
    df = postings.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.select("doc_id", "t_id", F.posexplode("t_tokens").alias("pos", "token")).join(df, ["doc_id", "token"]).join(total, "doc_id").where(F.col("df") <= F.greatest(F.lit(12), F.floor(F.col("groups") / 8)))
    rarest = rare.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "t_id").orderBy("df", "pos"))).where("r <= 4")
    by_token = rarest.join(postings, ["doc_id", "token"]).select("doc_id", "t_id", "g_ord").distinct()
    generic = asked.join(rare.select("doc_id", "t_id").distinct(), ["doc_id", "t_id"], "left_anti")
    singles = generic.join(known.where("n = 1"), "doc_id").withColumn("cheap", cheap_similarity(F.col("t_tokens"), F.col("t_grams"), F.col("g_tokens"), F.col("g_grams")))
    best = singles.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "t_id").orderBy(F.desc("cheap"), "g_ord"))).where("r <= 20 and cheap > 0").select("doc_id", "t_id", F.col("members")[0].alias("seg"))
    by_line = best.join(known.select("doc_id", "g_ord", F.explode("members").alias("seg")), ["doc_id", "seg"]).select("doc_id", "t_id", "g_ord").distinct()
    pool = exact.unionByName(by_token).unionByName(by_line).distinct()
    few = asked.select("doc_id", "t_id", "t_grams").join(pool.groupBy("doc_id", "t_id").agg(F.count(F.lit(1)).alias("found")), ["doc_id", "t_id"], "left").where(F.coalesce("found", F.lit(0)) < limit)
    gram_postings = known.select("doc_id", "g_ord", F.explode("g_grams").alias("gram"))
    gram_df = gram_postings.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("df")).join(total, "doc_id").where(F.col("df") <= F.greatest(F.lit(40), F.floor(F.col("groups") / 3))).select("doc_id", "gram")
    votes = few.select("doc_id", "t_id", F.explode("t_grams").alias("gram")).join(gram_df, ["doc_id", "gram"]).join(gram_postings, ["doc_id", "gram"]).groupBy("doc_id", "t_id", "g_ord").agg(F.count(F.lit(1)).alias("votes"))
    by_gram = votes.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "t_id").orderBy(F.desc("votes"), "g_ord"))).where(F.col("r") <= 2 * limit).select("doc_id", "t_id", "g_ord")
    other = pool.unionByName(by_gram).distinct().join(exact, ["doc_id", "t_id", "g_ord"], "left_anti")
    scored = other.join(asked, ["doc_id", "t_id"]).join(known, ["doc_id", "g_ord"]).withColumn("cheap", cheap_similarity(F.col("t_tokens"), F.col("t_grams"), F.col("g_tokens"), F.col("g_grams")))
    part = Window.partitionBy("doc_id", "t_id")
    sure = exact.join(asked, ["doc_id", "t_id"]).join(known, ["doc_id", "g_ord"]).withColumn("exact", F.lit(True)).withColumn("place", F.row_number().over(part.orderBy("g_ord")))
    likely = scored.withColumn("exact", F.lit(False)).withColumn("place", F.row_number().over(part.orderBy(F.desc("cheap"), "g_ord"))).where(F.col("place") <= limit)
    shown = ["doc_id", "t_id", "g_ord", "exact", "place", "t_norm", "t_tokens", "g_norm", "g_tokens", "members", "n"]
    return sure.select(*shown).unionByName(likely.select(*shown))


class _Lines:
    """The lines of one document and their groups, indexed by tokens and trigrams."""

    def __init__(self, segments: pd.DataFrame):
        self.rows = list(segments.sort_values("ord").itertuples())
        placed = sorted((i for i, r in enumerate(self.rows) if r.x == r.x and r.y == r.y), key=lambda i: (self.rows[i].page, self.rows[i].y, self.rows[i].x, i))
        follows = {i: next((j for j in self._behind(placed, k) if self._in_column(i, j)), None) for k, i in enumerate(placed)}
        self.groups: list[tuple[int, ...]] = [(i,) for i in range(len(self.rows))]
        for i in placed:
            chain = (i,)
            while len(chain) < 4 and follows[chain[-1]] is not None:
                chain += (follows[chain[-1]],)
                self.groups.append(chain)
        self.norms = [plain_layout("\n".join(self.rows[i].text or "" for i in g)) for g in self.groups]
        self.tokens = [frozenset(n.split()) for n in self.norms]
        self.grams = [gram_set(n) for n in self.norms]
        self.by_token, self.by_gram = _postings(self.tokens), _postings(self.grams)
        self.of_line: dict[int, list[int]] = {}
        for g, members in enumerate(self.groups):
            for i in members:
                self.of_line.setdefault(i, []).append(g)

    def _behind(self, placed: list[int], k: int):
        page = self.rows[placed[k]].page
        return itertools.takewhile(lambda j: self.rows[j].page == page, placed[k + 1 :])

    def _in_column(self, i: int, j: int) -> bool:
        a, b = self.rows[i], self.rows[j]
        overlap = min(a.x + a.width, b.x + b.width) - max(a.x, b.x)
        return -0.01 <= b.y - (a.y + a.height) <= 0.08 and abs(a.x - b.x) <= 0.18 and overlap >= -0.02

    def shortlist(self, text: str, limit: int) -> list[int]:
        """Groups worth comparing: those that hold or are held, then the best of those with rare tokens or trigrams in common."""
        tokens, grams, n = frozenset(text.split()), gram_set(text), len(self.groups)

        @functools.cache
        def likeness(g: int) -> tuple[float, int]:
            part = 0.72 * len(tokens & self.tokens[g]) / max(len(tokens), 1) + 0.28 * len(grams & self.grams[g]) / max(len(grams), 1)
            return -part, g

        exact = [g for g, own in enumerate(self.norms) if text in own or (len(own) >= 4 and own in text)]
        rare = [t for t in tokens if 0 < len(self.by_token.get(t, ())) <= max(12, n // 8)]
        pool = set(exact).union(*(self.by_token[t] for t in heapq.nsmallest(4, rare, key=lambda t: (len(self.by_token[t]), t))))
        if not rare:
            for part, g in heapq.nsmallest(20, map(likeness, range(len(self.rows)))):
                if part < 0:
                    pool.update(self.of_line[g])
        if len(pool) < limit:
            votes = collections.Counter(g for t in grams if len(self.by_gram.get(t, ())) <= max(40, n // 3) for g in self.by_gram.get(t, ()))
            pool.update(heapq.nsmallest(2 * limit, votes, key=lambda g: (-votes[g], g)))
        return exact + [g for _, g in heapq.nsmallest(limit, map(likeness, pool.difference(exact)))]


def plain_layout(text: str) -> str:
    """normalize_layout of a Python string."""
    low = _MARKS.sub("", text.lower().translate(_FOLDED))
    low = re.sub(r"\s+([,.:;])", r"\1", re.sub(r"[^a-z0-9%/.,:-]+", " ", low))
    return " ".join(re.sub(r"\s*([/-])\s*", r"\1", low).split())


def gram_set(norm: str) -> frozenset[str]:
    padded = f"  {norm}  "
    return frozenset(map("".join, zip(padded, padded[1:], padded[2:])))


def _postings(sets: list[frozenset]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for g, members in enumerate(sets):
        for m in members:
            out.setdefault(m, []).append(g)
    return out


def text_score(needle: str, hay: str) -> float:
    """F15 of two normal forms."""
    if not needle or not hay:
        return 0.0
    if needle in hay:
        return 0.82 + 0.18 * len(needle) / len(hay)
    if len(hay) >= 4 and hay in needle:
        return 0.72 + 0.18 * len(hay) / len(needle)
    words = set(needle.split())
    return max(0.78 * difflib.SequenceMatcher(None, needle, hay).ratio(), 0.84 * len(words & set(hay.split())) / max(len(words), 1))


def document_boxes(fields: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
    """F19, F21 for one document: its fields take their boxes one after another."""
    lines, used, out = _Lines(segments), set(), []

    def best(texts: list[str]) -> tuple[float, tuple[int, ...]]:
        found: tuple[float, tuple[int, ...]] = (0.0, ())
        for g in dict.fromkeys(g for t in texts for g in lines.shortlist(t, MAX_FUZZY)):
            members = lines.groups[g]
            for t in texts:
                score = text_score(t, lines.norms[g]) * 0.94 ** len(used.intersection(members))
                words = set(t.split())
                if len(members) > 1 and len(words & lines.tokens[g]) >= 0.8 * max(len(words), 1):
                    score = min(1.0, score + 0.04)
                if score > found[0]:
                    found = (score, members)
        return found

    for f in fields.sort_values("f_ord").itertuples():
        evidence, others = (list(filter(None, map(plain_layout, filter(None, some)))) for some in ([f.evidence], [f.value, f.norm]))
        score, members = best(evidence)
        if score < ACCEPT_EVIDENCE and others:
            score, members = best(evidence + others)
        if score < ACCEPT:
            continue
        used.update(members)
        rows = [lines.rows[i] for i in members]
        left, top = min(r.x for r in rows), min(r.y for r in rows)
        right, bottom = max(r.x + r.width for r in rows), max(r.y + r.height for r in rows)
        out.append((f.doc_id, f.f_ord, round(score, 4), [r.seg_id for r in rows], rows[0].page, round(left, 6), round(top, 6), round(right - left, 6), round(bottom - top, 6), "\n".join(r.text or "" for r in rows)))
    return pd.DataFrame(out, columns=["doc_id", "f_ord", "score", "segment_ids", "page", "x", "y", "width", "height", "box_text"])


def attach_boxes(fields: DataFrame, segments: DataFrame) -> DataFrame:
    """fields (doc_id, f_ord, field_key, evidence, value, norm) with page, box, score and segments.

    A document's fields and segments meet once, by doc_id, and its boxes are
    chosen there: they depend on each other in order.  Evidence that reaches 0.7
    decides alone; else all texts together must reach 0.48; a group counts 0.94
    for each segment taken before.  A document is bounded by its pages.
    """
    doc, ord_ = (fields.schema[c].dataType.simpleString() for c in ("doc_id", "f_ord"))
    box = "score double, segment_ids array<string>, page int, x double, y double, width double, height double, box_text string"
    lines = segments.select("doc_id", "seg_id", "ord", "page", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    asked = fields.select("doc_id", "f_ord", "evidence", "value", "norm").where(F.coalesce("evidence", "value", "norm").isNotNull())
    boxes = asked.groupBy("doc_id").cogroup(lines.groupBy("doc_id")).applyInPandas(document_boxes, f"doc_id {doc}, f_ord {ord_}, {box}")
    out = fields.join(boxes, ["doc_id", "f_ord"], "left")
    return out.withColumn("box_id", F.when(F.col("score").isNotNull(), F.concat(F.lit("box-field-"), "field_key")))


def best_single(fields: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, f_ord, seg_id, score): each field's best segment by itself, 0.48 at least.

    A segment that equals one of a field's texts can't be beaten, so the first such
    is found by an equi-join.  Only fields without one meet all segments of their
    document, and the string ratio only pairs whose lengths let it count.
    """
    t = F.filter(F.array("evidence", "value", "norm"), lambda x: missing(x).isNotNull())
    texts = fields.select("doc_id", "f_ord", F.posexplode(t).alias("kind", "text"))
    a = texts.withColumn("t_norm", normalize_layout(F.col("text"))).drop("text")
    b = segments.withColumn("g_norm", normalize_layout(F.coalesce("text", F.lit("")))).select("doc_id", "seg_id", "ord", "g_norm")
    by_norm = b.where("g_norm <> ''").groupBy("doc_id", F.col("g_norm").alias("t_norm")).agg(F.max(F.struct((-F.col("ord")).alias("before"), "seg_id")).alias("s"))
    met = a.join(by_norm, ["doc_id", "t_norm"], "left").groupBy("doc_id", "f_ord").agg(F.collect_list(F.struct("kind", "t_norm")).alias("texts"), F.max("s").alias("s"))
    equal = met.where("s is not null").select("doc_id", "f_ord", "s.seg_id", F.lit(1.0).alias("score"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    rest = met.where("s is null").select("doc_id", "f_ord", F.inline("texts")).withColumn("t_tokens", words("t_norm"))
    pairs = rest.join(b.withColumn("g_tokens", words("g_norm")), "doc_id")
    best = pairs.withColumn("score", likely_score(F.col("t_norm"), F.col("g_norm"), F.col("t_tokens"), F.col("g_tokens"), ACCEPT)).groupBy("doc_id", "f_ord").agg(F.max_by(F.struct("seg_id", "score"), F.struct("score", -F.col("ord"), -F.col("kind"))).alias("b"))
    near = best.select("doc_id", "f_ord", "b.seg_id", F.round("b.score", 4).alias("score")).where(F.col("score") >= ACCEPT)
    return equal.unionByName(near)


def rematch(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, changed): fields whose fingerprint is that of the boxed ones take their boxes over; the others are to be matched."""
    prints = lambda df: df.withColumn("fp", F.sha2(F.to_json(F.struct("evidence", "value", "norm"), {"ignoreNullFields": "false"}), 256))
    kept = [c for c in old.columns if c not in new.columns]
    before = prints(old).select("doc_id", "field_key", F.col("fp").alias("old_fp"), *kept)
    both = prints(new).join(before, ["doc_id", "field_key"], "left")
    same = F.col("fp").eqNullSafe(F.col("old_fp"))
    return both.where(same).drop("fp", "old_fp"), both.where(~same).drop("fp", "old_fp", *kept)


def merge_matching(records: DataFrame, matches: DataFrame) -> DataFrame:
    """records with their match columns; review is needed if either says so."""
    joined = records.join(matches.withColumnRenamed("needs_review", "m_review"), "doc_id", "left")
    return joined.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.coalesce("m_review", F.lit(False))).drop("m_review")


def page_count(chunks: DataFrame) -> DataFrame:
    """K6: (doc_id, pages): distinct pages that the spans of a document's chunks cover."""
    return chunks.select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("p")).groupBy("doc_id").agg(F.count_distinct("p").alias("pages"))


def parts_of(files: DataFrame, size: int = 14) -> DataFrame:
    """(file, part, offset, pages) of files (file, pages) cut into parts of at most ``size`` pages."""
    parts = files.where("pages > 0").select("file", "pages", F.posexplode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(size))).alias("part", "offset"))
    return parts.select("file", "part", "offset", F.least(F.lit(size), F.col("pages") - F.col("offset")).alias("pages"))

