"""Merging fields from rules with fields from a payload, and what follows from the result.

Long tables (doc_id, field_key, value, norm, amount, evidence, confidence,
source) come together in one full outer join per document and field; a document's
context is a row of (doc_id, ...) joined beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.text import let, missing, normalize_rules
from docweave.operators import classify as C
from docweave.operators.extract import canonical_number

MONEY_KEYS = ["approved_value", "submitted_value", "estimated_value", "contract_value", "contractor_contract_amount", "performance_guarantee_value", "advance_guarantee_value"]
PERCENT_KEYS = ["contract_vat_percent", "settlement_request_vat_percent", "appraisal_vat_percent"]
NUMBER_KEYS = ["document_number", "contract_number"]
DATE_KEYS = ["signed_or_effective_date", "signed_date", "performance_guarantee_end_date", "advance_guarantee_end_date"]
DETAIL_KEYS = ["document_number", "signed_or_effective_date", "issuer", "title"]
CORE_KEYS = ["contract_name", "contract_number", "signed_date", "contract_value", "contractor_name"]
REVIEW_BELOW, ADAPTIVE_BELOW = 0.68, 0.72
COLUMNS = ["value", "norm", "amount", "evidence", "confidence", "source"]


def normalize_candidates(fields: DataFrame) -> DataFrame:
    """M2: the candidates' values in the normal form of their kind of field."""
    key, source = F.col("field_key"), F.coalesce(missing(F.col("norm")), missing(F.col("value")))
    money = T.money_value(source)
    percent = T.first_percent(source)["number"]
    days = missing(F.regexp_extract(source, r"(?iu)(\d{1,4})\s*ngày", 1))
    number = canonical_number(source)
    raw = F.coalesce(missing(F.trim("value")), source)
    iso = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$"
    given = F.when(raw.rlike(iso), F.concat_ws("-", F.regexp_extract(raw, iso, 1), F.lpad(F.regexp_extract(raw, iso, 2), 2, "0"), F.lpad(F.regexp_extract(raw, iso, 3), 2, "0")))
    date = F.coalesce(given, T.iso_date(F.coalesce(T.first_date(raw), raw)))
    shown = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    norm = (
        F.when(key.isin(MONEY_KEYS), money.cast("string")).when(key.isin(PERCENT_KEYS), shown(percent)).when(key == "execution_duration_days", F.regexp_replace(days, r"^0+(?=\d)", ""))
        .when(key.isin(NUMBER_KEYS), number).when(key.isin(DATE_KEYS), date)
    )
    amount = F.when(key.isin(MONEY_KEYS), money.cast("double")).when(key.isin(PERCENT_KEYS), percent).when(key == "execution_duration_days", days.cast("double"))
    value = F.when(key.isin(NUMBER_KEYS), number).when(key.isin(DATE_KEYS), T.display_date(date))
    return fields.withColumns({"__n": norm, "__a": amount, "__v": value}).withColumns({"norm": F.coalesce("__n", "norm"), "amount": F.coalesce("__a", "amount"), "value": F.coalesce("__v", "value")}).drop("__n", "__a", "__v")


def cites_other(value: Column, norm: Column, evidence: Column) -> Column:
    """True if a date stands with the name of a law or another text."""
    return normalize_rules(F.concat_ws(" ", value, norm, evidence)).rlike("|".join(C.DATE_REFERENCES))


def should_replace(old: str, new: str, key: Column) -> Column:
    """M3: whether the candidate ``new`` takes the place of ``old`` (prefixes of their columns)."""
    o, n = (lambda c: F.col(f"{old}{c}")), (lambda c: F.col(f"{new}{c}"))
    own, other = F.coalesce(o("confidence"), F.lit(0.0)), F.coalesce(n("confidence"), F.lit(0.0))
    llm = (F.coalesce(n("source"), F.lit("rule")) == "llm") & (F.coalesce(o("source"), F.lit("rule")) == "rule")
    dates = key.isin("signed_or_effective_date", "signed_date")
    return (
        F.when(missing(n("value")).isNull(), False)
        .when(dates & cites_other(n("value"), n("norm"), n("evidence")), False)
        .when(missing(o("value")).isNull(), True)
        .when(dates & llm & (own >= 0.9), False)
        .when(llm, other >= own - 0.15)
        .otherwise(other >= own + 0.08)
    )


def merge_fields(rules: DataFrame, payload: DataFrame) -> DataFrame:
    """M1: one row per document and field of either side, the better of both."""
    a = rules.select("doc_id", "field_key", *[F.col(c).alias(f"r_{c}") for c in COLUMNS])
    b = normalize_candidates(payload).select("doc_id", "field_key", *[F.col(c).alias(f"p_{c}") for c in COLUMNS])
    both = a.join(b, ["doc_id", "field_key"], "full_outer")
    take = should_replace("r_", "p_", F.col("field_key"))
    out = both.withColumn("__take", take)
    return out.select("doc_id", "field_key", *[F.when(F.col("__take"), F.col(f"p_{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in COLUMNS]).where(missing(F.col("value")).isNotNull())


def guard_fields(merged: DataFrame, rules: DataFrame, context: DataFrame) -> DataFrame:
    """M4: layout-bound fields come from the rules, whatever the payload says.

    context: doc_id, is_registration, number_lines (array of canonical numbers
    of the header's number lines).
    """
    rule = rules.select("doc_id", "field_key", *[F.col(c).alias(f"r_{c}") for c in COLUMNS])
    df = merged.join(rule, ["doc_id", "field_key"], "full_outer").join(context.select("doc_id", "is_registration", "number_lines"), "doc_id", "left")
    key, has_rule = F.col("field_key"), F.col("r_value").isNotNull()
    norm = canonical_number(F.coalesce(missing(F.col("norm")), F.col("value")))
    foreign = normalize_rules(F.concat_ws(" ", "value", "evidence")).rlike("ma so doanh nghiep|ma so thue|so tai khoan")
    df = df.withColumn("__norm", norm)
    valid = ~foreign & F.coalesce(F.exists("number_lines", lambda x: x.contains(F.col("__norm"))), F.lit(False))
    total = has_rule & normalize_rules(F.coalesce("r_evidence", F.lit(""))).contains("tong cong")
    use = (
        F.when((key == "document_number") & F.coalesce("is_registration", F.lit(False)), "none").when((key == "document_number") & has_rule, "rule").when((key == "document_number") & ~F.coalesce(valid, F.lit(False)), "none")
        .when(key.isin("signed_or_effective_date", "issuer"), F.when(has_rule, "rule").otherwise("none")).when((key == "approved_value") & total, "rule").otherwise("merged")
    )
    df = df.withColumn("__use", use)
    out = df.select("doc_id", "field_key", *[F.when(F.col("__use") == "rule", F.col(f"r_{c}")).when(F.col("__use") == "merged", F.col(c)).alias(c) for c in COLUMNS])
    return out.where(missing(F.col("value")).isNotNull())


def route_values(fields: DataFrame, roles: DataFrame) -> DataFrame:
    """M5: amounts go to the field of the document's role; roles is (doc_id, value_role)."""
    keys = ["approved_value", "submitted_value"]
    rest = fields.where(~F.col("field_key").isin(keys))
    packed = fields.where(F.col("field_key").isin(keys)).groupBy("doc_id").pivot("field_key", keys).agg(F.first(F.struct(*COLUMNS)))
    df = packed.join(roles.select("doc_id", "value_role"), "doc_id", "left").withColumn("value_role", F.coalesce("value_role", F.lit("none")))
    a, s, role = F.col("approved_value"), F.col("submitted_value"), F.col("value_role")
    capped = lambda x: x.withField("confidence", F.least(F.when(F.coalesce(x["confidence"], F.lit(0.0)) != 0, x["confidence"]).otherwise(F.lit(0.78)), F.lit(0.84)))
    to_submitted, to_approved = (role == "submitted"), role.isin("approved", "contract_approved")
    new_a = F.when(to_approved, F.coalesce(a, capped(s)))
    same = a["norm"].isNotNull() & (a["norm"] == s["norm"])
    new_s = F.when(to_submitted, F.coalesce(s, capped(a))).when(to_approved & a.isNotNull() & ~F.coalesce(same, F.lit(False)), s)
    pair = F.array(*[F.struct(F.lit(k).alias("field_key"), x.alias("f")) for k, x in (("approved_value", new_a), ("submitted_value", new_s))])
    moved = df.select("doc_id", F.explode(F.filter(pair, lambda x: x["f"].isNotNull())).alias("x")).select("doc_id", "x.field_key", "x.f.*")
    return rest.select("doc_id", "field_key", *COLUMNS).unionByName(moved)


def confidence(fields: DataFrame, docs: DataFrame, screen: str = "work_detail", review_below: float = REVIEW_BELOW) -> DataFrame:
    """M7, M8: doc_id, local_confidence, needs_review of every document.

    Documents: the mean over four fields, a missing one counting 0; contracts:
    the mean over the fields present.
    """
    have = fields.where(missing(F.col("value")).isNotNull())
    if screen == "work_detail":
        score = have.where(F.col("field_key").isin(DETAIL_KEYS)).groupBy("doc_id").agg((F.sum("confidence") / len(DETAIL_KEYS)).alias("c"))
    else:
        score = have.groupBy("doc_id").agg(F.avg("confidence").alias("c"))
    out = docs.select("doc_id").join(score, "doc_id", "left").withColumn("local_confidence", F.round(F.coalesce("c", F.lit(0.0)), 4))
    return out.select("doc_id", "local_confidence", (F.col("local_confidence") < review_below).alias("needs_review"))


def overlay(base: Column, given: Column) -> Column:
    """M6: a map over which the other map's non-empty entries are laid."""
    kept = F.map_filter(given, lambda k, v: v.isNotNull() & (v != ""))
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k))), F.map_entries(kept)))


def routing(wide: DataFrame, kind: str = "document", below: float = ADAPTIVE_BELOW) -> DataFrame:
    """M9: the rows with use_llm and llm_reason.

    wide: the field structs, and for documents title_kind, is_registration,
    value_role and money_signal.
    """
    present = lambda k: missing(F.col(f"{k}.value")).isNotNull()
    if kind == "contract":
        n = sum((present(k).cast("int") for k in CORE_KEYS[1:]), present(CORE_KEYS[0]).cast("int"))
        total = sum((F.when(present(k), F.col(f"{k}.confidence")).otherwise(0.0) for k in CORE_KEYS[1:]), F.when(present(CORE_KEYS[0]), F.col(f"{CORE_KEYS[0]}.confidence")).otherwise(0.0))
        reason = F.when(n < 4, F.concat(F.lit("contract_core_fields_"), n.cast("string"), F.lit("_of_5"))).when(total / n < below, "contract_core_confidence_low").otherwise("contract_core_fields_sufficient")
        return wide.withColumn("llm_reason", reason).withColumn("use_llm", F.col("llm_reason") != "contract_core_fields_sufficient")
    named = F.coalesce(F.col("title_kind"), C.title_kind(F.array(F.struct(F.col("title.value").alias("t"), normalize_rules(F.col("title.value")).alias("n")))))
    internal, registration = C.is_unissued(named), F.coalesce(F.col("is_registration"), F.lit(False))
    expected = F.concat(
        F.when(named.isNull(), F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")),
        F.when(~internal & ~registration, F.array(*map(F.lit, DETAIL_KEYS[:3]))).when(~internal, F.array(*map(F.lit, DETAIL_KEYS[1:3]))).otherwise(F.array().cast("array<string>")),
    )
    df = T.once(wide, __expected=expected, __held=F.filter(F.array(*[F.when(present(k), F.struct(F.lit(k).alias("k"), F.col(f"{k}.confidence").alias("c"))) for k in DETAIL_KEYS]), lambda x: x.isNotNull()))
    lacking = F.filter("__expected", lambda k: ~F.exists("__held", lambda h: h["k"] == k))
    own = F.transform(F.filter("__held", lambda h: F.array_contains("__expected", h["k"])), lambda h: h["c"])
    mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)
    role = F.col("value_role")
    value_key = F.when(role == "submitted", "submitted_value").when(role.isin("approved", "contract_approved"), "approved_value")
    no_value = F.when(value_key == "submitted_value", ~present("submitted_value")).when(value_key == "approved_value", ~present("approved_value"))
    reason = (
        F.when(F.size(lacking) > 0, F.concat(F.lit("missing_"), F.array_join(lacking, "_"))).when((F.size(own) > 0) & (mean < below), "document_required_confidence_low")
        .when(F.col("money_signal") & no_value, F.concat(F.lit("missing_"), value_key)).otherwise("local_fields_sufficient")
    )
    return df.withColumn("llm_reason", reason).withColumn("use_llm", F.col("llm_reason") != "local_fields_sufficient").drop("__expected", "__held")


def execution_mode(mode: str | None = None, fallback_enabled: bool | None = None) -> str:
    """Off, always or adaptive; a switched-off fallback means off."""
    if fallback_enabled is False:
        return "off"
    return mode if mode in ("off", "always", "adaptive") else "adaptive"


def fields_to_request(fields: DataFrame, keys: list[str], below: float = ADAPTIVE_BELOW) -> DataFrame:
    """(doc_id, requested): the fields missing or below, or all of them if none is."""
    sure = fields.where((F.col("confidence") >= below) & missing(F.col("value")).isNotNull()).groupBy("doc_id").agg(F.collect_set("field_key").alias("sure"))
    wanted = F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.array_contains("sure", k))
    return fields.select("doc_id").distinct().join(sure, "doc_id", "left").withColumn("sure", F.coalesce("sure", F.array().cast("array<string>"))).select("doc_id", let(wanted, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(*map(F.lit, keys)))).alias("requested"))


def extract_information(docs: DataFrame, kind: str = "document", mode: str = "off", provider=None, compose: bool = True) -> DataFrame:
    """Clean, extract, decide, ask the provider for the routed documents only, merge.

    provider: DataFrame of routed documents -> long payload table; without one,
    or with mode off, every document keeps the rules' fields and says so.
    """
    from docweave.operators import extract as E
    from docweave.operators.cleaning import clean_documents

    cleaned = clean_documents(docs, compose=compose)
    wide = E.contract_fields(cleaned) if kind == "contract" else E.document_fields(cleaned)
    keys = E.CONTRACT_FIELDS if kind == "contract" else E.DOCUMENT_FIELDS
    rules = E.long_fields(wide, keys)
    used = rules
    if provider is not None and mode != "off":
        df = C.with_lines(cleaned)
        numbers = F.transform(F.filter(C.head(60), lambda x: C.is_number_line(x["t"])), lambda x: F.coalesce(canonical_number(x["t"]), F.lit("")))
        context = df.select("doc_id", C.is_registration().alias("is_registration"), C.money_signal(F.col("body")).alias("money_signal"), numbers.alias("number_lines"))
        routed = routing(wide.join(context.drop("number_lines"), "doc_id", "left"), kind)
        used = merge_fields(rules, provider(routed if mode == "always" else routed.where("use_llm")))
        if kind == "document":
            used = route_values(guard_fields(used, rules, context), wide.select("doc_id", "value_role"))
    score = confidence(used, wide, "contract" if kind == "contract" else "work_detail")
    packed = used.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", F.struct(*COLUMNS).alias("f"))))).alias("fields"))
    intent = F.lit("contract") if kind == "contract" else F.col("intent")
    head = wide.select("doc_id", intent.alias("document_intent"), "note_list", F.lit(kind).alias("document_type"), F.lit("contract" if kind == "contract" else "work_detail").alias("screen"))
    return head.join(packed, "doc_id", "left").join(score, "doc_id", "left").withColumn("provider", F.lit("unavailable" if provider is None else mode))
