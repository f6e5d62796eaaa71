"""Linking documents to a catalogue: abbreviations, TF-IDF, hybrid scores, ranking, status.

Queries and candidates are rows.  TF-IDF is relational: grams, document
frequencies and weights are tables, and scores come from a join on the gram.
A catalogue is a dimension; pairs are all queries of a document against the
candidates of its catalogue, which is what ranking asks for, and the costly string
ratio runs as an Arrow UDF after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import let, missing, normalize_match, normalize_rules, sequence_ratio, significant_tokens, strip_edges, collapse
from docweave.operators.classify import matching_type
from docweave.operators.dims import ABBREVIATIONS

ACTIVE_STATUSES = ["executing", "in_progress", "processing", "doing", "started"]
SEARCHABLE_STATUSES = ["executing", "preparing", "closed"]
PROJECT_AT, TASK_AT, LLM_GAP, LLM_ACCEPT = 0.78, 0.55, 0.15, 0.6


def expand_abbreviations(c: Column) -> Column:
    """Abbreviations between word boundaries by what they stand for, longest first."""
    quote = lambda a: "".join("\\" + x if not x.isalnum() and x != " " else x for x in a)
    ordered = sorted(ABBREVIATIONS.items(), key=lambda kv: -len(kv[0]))
    # within a lambda the long chain is evaluated as it stands, not compiled into one method beyond the JVM's limit
    return let(c, lambda x: reduce(lambda out, kv: F.regexp_replace(out, rf"(?U)\b{quote(kv[0])}\b", kv[1]), ordered, x))


def char_grams(norm: Column, low: int = 2, high: int = 5) -> Column:
    """The character grams of each word between blanks; a padded word no longer than n is one gram of that length."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))

        def grams(n: int) -> Column:
            # a word shorter than the first length that holds it whole gives no longer grams
            count = F.length(w) - n + 1
            whole = F.when(F.length(w) == n - 1, F.array().cast("array<string>"))
            return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.coalesce(whole, F.array().cast("array<string>")))

        return F.flatten(F.array(*[grams(n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(F.filter(F.split(norm, " ", -1), lambda w: w != ""), of))


def tfidf_weights(texts: DataFrame, key: str, norm: str = "norm", idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights (key, gram, w), idf (gram, idf)): raw counts, smooth idf, rows of unit length.

    idf given: the texts are queries, and grams that it doesn't hold go.
    """
    tf = texts.select(key, F.explode(char_grams(F.col(norm))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    if idf is None:
        n = texts.where(F.col(norm).isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"))
        df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        idf = df.join(F.broadcast(n), F.lit(True)).select("gram", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, key).select(key, "gram", (F.col("w") / F.col("len")).alias("w")), idf


def tfidf_scores(queries: DataFrame, candidates: DataFrame, query: str = "query_id", candidate: str = "cand_id") -> DataFrame:
    """(query, candidate, tfidf) of pairs with a gram in common; both have a column ``norm``."""
    weights, idf = tfidf_weights(candidates, candidate)
    asked, _ = tfidf_weights(queries, query, idf=idf)
    pairs = asked.withColumnRenamed("w", "wq").join(weights, "gram")
    return pairs.groupBy(query, candidate).agg(F.sum(F.col("wq") * F.col("w")).alias("tfidf"))


def overlap(q: Column, c: Column) -> Column:
    """(matched, query_coverage, candidate_coverage, jaccard) of two token sets."""
    m = F.size(F.array_intersect(q, c))
    one = lambda n: F.greatest(n, F.lit(1))
    return let(m, lambda k: F.struct(k.alias("matched"), (k / one(F.size(q))).alias("query_coverage"), (k / one(F.size(c))).alias("candidate_coverage"), (k / one(F.size(F.array_union(q, c)))).alias("jaccard")))


def longest_run(words: Column, members: Column) -> Column:
    """the longest run of words that are all among the members."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(F.array_contains(members, w), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(words, start, step)["best"]


def with_forms(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """The columns of a text that scoring needs: its normal form, tokens, words and document type."""
    norm = normalize_match(F.col(text))
    df = df.withColumn(f"{prefix}_norm", norm).withColumn(f"{prefix}_tokens", significant_tokens(F.col(f"{prefix}_norm")))
    words = F.filter(F.split(f"{prefix}_norm", " ", -1), lambda w: F.array_contains(f"{prefix}_tokens", w))
    return df.withColumn(f"{prefix}_words", words).withColumn(f"{prefix}_type", matching_type(F.col(text)))


def type_adjustment(a: Column, b: Column) -> Column:
    """F7."""
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 0.08).otherwise(-0.08)


def hybrid_score(pairs: DataFrame) -> DataFrame:
    """pairs (q_* and c_* forms, tfidf) with score and its parts.

    Without a fuzzy library the fuzzy part is the sequence ratio.
    """
    df = pairs.withColumn("sequence", sequence_ratio(F.col("q_norm"), F.col("c_norm"))).withColumn("o", overlap(F.col("q_tokens"), F.col("c_tokens"))).withColumn("run", longest_run(F.col("q_words"), F.col("c_tokens")))
    n = F.size("q_tokens")
    short = F.when(n < 6, (6 - n) * 0.05).otherwise(0.0)
    adjust = type_adjustment(F.col("q_type"), F.col("c_type"))
    c_in_q, q_in_c = F.col("q_norm").contains(F.col("c_norm")), F.col("c_norm").contains(F.col("q_norm"))
    qc, cc, jac, m = F.col("o.query_coverage"), F.col("o.candidate_coverage"), F.col("o.jaccard"), F.col("o.matched")
    bonus = F.least(F.lit(0.06), qc * 0.08)
    exact = F.greatest(F.when(c_in_q, 0.78 + bonus).otherwise(0.0), F.when(q_in_c, 0.75 + bonus - F.greatest(F.lit(0.0), (1 - cc) * 0.08)).otherwise(0.0))
    steps = lambda x, marks: reduce(lambda acc, mk: acc.when(x >= mk[0], mk[1]), marks[1:], F.when(x >= marks[0][0], marks[0][1])).otherwise(0.0)
    run_bonus, count_bonus = steps(F.col("run"), [(8, 0.08), (5, 0.05), (3, 0.02)]), steps(m, [(10, 0.06), (7, 0.04), (5, 0.02)])
    token = 0.40 * qc + 0.35 * cc + 0.25 * jac
    weighted = 0.25 * F.col("sequence") + 0.28 * F.col("tfidf") + 0.38 * token + 0.09 * F.col("sequence")
    bare_exact = F.greatest(F.when(c_in_q, 0.96).otherwise(0.0), F.when(q_in_c, 0.92).otherwise(0.0))
    bare = (n == 0) | (F.size("c_tokens") == 0)
    raw = F.when(bare, F.greatest(bare_exact, 0.55 * F.col("sequence") + 0.45 * F.col("sequence"))).otherwise(F.greatest(exact, weighted) + run_bonus + count_bonus) + adjust - short
    score = F.when((F.col("q_norm") == "") | (F.col("c_norm") == ""), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4))
    parts = F.struct(
        F.round(F.when(bare, bare_exact).otherwise(exact), 4).alias("exact"), F.round("sequence", 4).alias("rapidfuzz"), F.round("tfidf", 4).alias("tfidf"), F.round(F.when(bare, 0.0).otherwise(token), 4).alias("token"),
        F.round("sequence", 4).alias("sequence"), F.when(bare, 0).otherwise(F.col("run")).alias("longest_sequence"), F.when(bare, 0.0).otherwise(run_bonus).alias("longest_seq_bonus"),
        F.when(bare, 0).otherwise(m).alias("matched_tokens"), F.when(bare, 0.0).otherwise(count_bonus).alias("matched_count_bonus"), F.round(qc, 4).alias("query_coverage"), F.round(cc, 4).alias("candidate_coverage"),
        n.alias("query_token_count"), F.round(short, 4).alias("short_query_penalty"), adjust.alias("doc_type_adjustment"),
    )
    return df.withColumn("score", score).withColumn("score_breakdown", parts).drop("o", "run", "sequence")


def best_query(scored: DataFrame, keys: list[str]) -> DataFrame:
    """F8: for each keys, the query that wins a walk through queries in order.

    A query wins if it scores 0.02 more, or less than 0.02 less with more tokens;
    the walk depends on order, so it is a fold over the sorted queries.
    """
    start = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("query"), F.lit(0).alias("n"), F.lit(None).cast(scored.schema["score_breakdown"].dataType).alias("score_breakdown"))

    def step(best: Column, x: Column) -> Column:
        wins = (x["score"] - best["score"] >= 0.02) | ((x["score"] - best["score"] > -0.02) & (x["n"] > best["n"]))
        return F.when(wins, F.struct(x["score"].alias("score"), x["query"].alias("query"), x["n"].alias("n"), x["score_breakdown"].alias("score_breakdown"))).otherwise(best)

    rows = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q_ord", "score", "query", F.size("q_tokens").alias("n"), "score_breakdown"))).alias("g"))
    return rows.withColumn("b", F.aggregate("g", start, step)).select(*keys, F.col("b.score").alias("score"), F.col("b.query").alias("matched_query"), F.col("b.score_breakdown").alias("score_breakdown"))


def rank(queries: DataFrame, candidates: DataFrame, top: int | None = None, use_tfidf: bool = True) -> DataFrame:
    """(doc_id, cand_id, score, matched_query, score_breakdown, rank), best first, ties in input order.

    queries: doc_id, q_ord, query.  candidates: cand_id, c_ord, text.  Equal
    queries of all documents are scored once.
    """
    asked = queries.where(missing(F.trim("query")).isNotNull()).withColumn("query", expand_abbreviations(F.col("query")))
    distinct = with_forms(asked.select("query").distinct(), "query", "q").withColumn("norm", F.col("q_norm"))
    known = with_forms(candidates.withColumn("text", expand_abbreviations(F.col("text"))), "text", "c").withColumn("norm", F.col("c_norm"))
    # every query of a document is ranked against the whole catalogue: that is the operator's result
    # whichever side streams, its rows stay dealt over all tasks, for the ratio of each pair is costly
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = distinct.drop("norm").repartition(n, "query").join(known.drop("norm").repartition(n, "cand_id"), F.lit(True), "inner")
    if use_tfidf:
        scores = tfidf_scores(distinct.select("query", "norm"), known.select("cand_id", "norm"), "query", "cand_id")
        pairs = pairs.join(scores, ["query", "cand_id"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    else:
        pairs = pairs.withColumn("tfidf", F.lit(0.0))
    scored = hybrid_score(pairs).select("query", "cand_id", "c_ord", "score", "score_breakdown", "q_tokens")
    best = best_query(asked.join(scored, "query"), ["doc_id", "cand_id", "c_ord"])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "c_ord")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def searchable_projects(projects: DataFrame) -> DataFrame:
    """Projects of a status to search that are active, which is the default."""
    return projects.where(F.lower(F.trim("status")).isin(SEARCHABLE_STATUSES) & F.coalesce("is_active", F.lit(True)))


def rank_projects(queries: DataFrame, projects: DataFrame, top: int = 3) -> DataFrame:
    """F10."""
    known = searchable_projects(projects).select(F.col("id").cast("string").alias("cand_id"), F.monotonically_increasing_id().alias("c_ord"), F.trim(F.concat_ws(" ", "name", "code")).alias("text"))
    return rank(queries, known, top)


def leaf_tasks(tasks: DataFrame) -> DataFrame:
    """the tasks that are no other task's parent."""
    parents = tasks.select(F.col("parent_id").cast("string").alias("p")).where(missing(F.col("p")).isNotNull())
    return tasks.join(parents, tasks["id"].cast("string") == F.col("p"), "left_anti")


def rank_tasks(queries: DataFrame, tasks: DataFrame, top: int = 3) -> DataFrame:
    """leaves by name, step, phase and status; active ones get 0.04 more and all are ranked again."""
    leaves = leaf_tasks(tasks)
    text = F.trim(F.concat_ws(" ", "name", "workflow_step.name", "workflow_step.phase", "status"))
    known = leaves.select(F.col("id").cast("string").alias("cand_id"), F.monotonically_increasing_id().alias("c_ord"), text.alias("text"))
    active = leaves.select(F.col("id").cast("string").alias("cand_id"), F.lower("status").isin(ACTIVE_STATUSES).alias("active"))
    again = rank(queries, known).join(active, "cand_id").withColumn("score", F.when(F.col("active"), F.round(F.least(F.lit(1.0), F.col("score") + 0.04), 4)).otherwise(F.col("score")))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "rank")
    return again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("active")


SITE = r"(?iuU)\b(?:dự án|du an|công trình|cong trinh)\b\s*[:\-]?"


def project_tail(title: Column) -> Column:
    """what a title says behind its first word for a project, up to the next kind of detail."""
    tail = F.get(F.split(title, SITE, 2), F.lit(1))
    cut = F.get(F.split(tail, r"(?iuU)\s+(?:địa điểm|dia diem|chủ đầu tư|chu dau tu|nguồn vốn|nguon von|gói thầu|goi thau|hạng mục|hang muc)\b", 2), F.lit(0))
    return missing(strip_edges(cut))


def _queries(values: Column, doc_id: str, df: DataFrame, least: int) -> DataFrame:
    keyed = F.transform(F.filter(values, lambda v: v.isNotNull() & (F.length(F.trim(v)) >= least)), lambda v: strip_edges(collapse(v)))
    unique = let(keyed, lambda k: F.filter(F.transform(k, lambda v, i: F.when(~F.exists(F.slice(k, 1, i), lambda u: normalize_rules(u) == normalize_rules(v)), v)), lambda v: v.isNotNull() & (v != "")))
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(unique).alias("q_ord", "query"))


def project_queries(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """the project candidates of a document, its title's tail and its title, each once."""
    values = F.concat(F.coalesce("project_name_candidates", F.array().cast("array<string>")), F.array(F.coalesce(project_tail(F.col("title")), "title"), F.col("title")))
    return _queries(values, doc_id, df, 1)


def task_queries(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """a document's title, without the words for subject, and of that what stands before the project; four characters or more."""
    plain = F.regexp_replace("title", r"(?iuU)\b(v/v|về việc|ve viec)\b", " ")
    return _queries(F.array(F.col("title"), plain, F.get(F.split(plain, SITE, 2), F.lit(0))), doc_id, df, 4)


def needs_tiebreak(score: Column, threshold: float, gap: float = LLM_GAP) -> Column:
    """Whether a best score below its threshold is near enough for a model to be asked."""
    return (score > 0) & (F.lit(threshold) - score > 0) & (F.lit(threshold) - score <= gap)


def match_status(docs: DataFrame, projects: DataFrame, tasks: DataFrame, project_choice: DataFrame | None = None, task_choice: DataFrame | None = None, problems: DataFrame | None = None) -> DataFrame:
    """doc_id, project_id, project_score, task_id, task_score, status, needs_review of every document.

    projects, tasks: best candidates (doc_id, cand_id, score, rank).  The choices
    (doc_id, id, confidence) are a model's, where one was asked.  problems
    (doc_id, problem): disabled, error (no projects were read) or task_error.
    """
    none = docs.select("doc_id").limit(0).select("doc_id", F.lit("").alias("id"), F.lit(0.0).alias("confidence"))
    top = lambda r, n: r.where("rank = 1").select("doc_id", F.col("cand_id").alias(f"{n}_id"), F.col("score").alias(f"{n}_score"))
    pick = lambda c, n: (none if c is None else c).select("doc_id", F.col("id").alias(f"{n}_pick"), F.col("confidence").alias(f"{n}_conf"))
    df = docs.select("doc_id").join(top(projects, "project"), "doc_id", "left").join(top(tasks, "task"), "doc_id", "left").join(pick(project_choice, "project"), "doc_id", "left").join(pick(task_choice, "task"), "doc_id", "left")
    by_score, by_llm = F.coalesce(F.col("project_score") >= PROJECT_AT, F.lit(False)), F.coalesce((F.col("project_conf") >= LLM_ACCEPT) & needs_tiebreak(F.col("project_score"), PROJECT_AT), F.lit(False))
    t_score, t_llm = F.coalesce(F.col("task_score") >= TASK_AT, F.lit(False)), F.coalesce((F.col("task_conf") >= LLM_ACCEPT) & needs_tiebreak(F.col("task_score"), TASK_AT), F.lit(False))
    status = (
        F.when(~by_score & ~by_llm, "not_matched")
        .when(by_score, F.when(t_score, "matched").when(t_llm, "project_matched_task_matched_by_llm").otherwise("project_matched_task_not_matched"))
        .otherwise(F.when(t_score, "project_matched_by_llm_task_matched").when(t_llm, "matched_by_llm").otherwise("project_matched_by_llm_task_not_matched"))
    )
    if problems is not None:
        df = df.join(problems.groupBy("doc_id").agg(F.min("problem").alias("problem")), "doc_id", "left")
        linked = status.startswith("project_matched") | status.contains("matched_by_llm") | (status == "matched")
        status = F.when(F.col("problem").isin("disabled", "error"), F.col("problem")).when((F.col("problem") == "task_error") & linked & (status != "not_matched"), "project_matched_task_error").otherwise(status)
        failed = F.coalesce(F.col("problem").isin("disabled", "error"), F.lit(False))
        by_score, by_llm = by_score & ~failed, by_llm & ~failed
        t_score, t_llm = t_score & F.col("problem").isNull(), t_llm & F.col("problem").isNull()
    has_p, has_t = by_score | by_llm, (by_score | by_llm) & (t_score | t_llm)
    project, task = F.when(by_score, F.col("project_id")).when(by_llm, F.col("project_pick")), F.when(t_score, F.col("task_id")).when(t_llm, F.col("task_pick"))
    return df.select("doc_id", project.alias("project_id"), F.when(has_p, F.col("project_score")).alias("project_score"), F.when(has_t, task).alias("task_id"), F.when(has_t, F.col("task_score")).alias("task_score"), status.alias("status"), (~has_t).alias("needs_review"))
