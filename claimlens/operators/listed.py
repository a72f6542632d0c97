"""Payment after a list action: events from several lists, their tiers and name checks, what was paid and enrolled
after them, the same provider active elsewhere, and flags with evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.functions.casts import evidence_json, flag_id
from claimlens.functions.keys import name_tokens, names_agree
from claimlens.operators.ranking import best_row, top_per_group
from claimlens.operators.sets import replace_slice
from claimlens.operators.temporal import lookback_join, month_window_join, overlap_join

EVENT_COLUMNS = ("npi", "source", "event_dt", "window_end", "reason", "source_state", "tier", "source_name", "source_type")
# Grounds of a revocation and codes of a termination that are of tier A; the code of a death.
TIER_A_GROUNDS = (2, 3, 4, 5, 7, 8, 10, 12, 13, 14, 18, 19, 20, 22, 23)
TIER_A_CODES = ("60", "62", "65", "66", "67", "70", "71", "72", "74", "75", "78", "81")
DECEASED_CODE = "80"
NAME_MATCH = "name_match"


def _event(df: DataFrame, source, event_dt, window_end, reason, state, tier, name, kind) -> DataFrame:
    lit = lambda x, t="string": x if isinstance(x, Column) else F.lit(x).cast(t)
    columns = (F.col("npi"), lit(source), lit(event_dt, "date"), lit(window_end, "date"), lit(reason), lit(state), lit(tier), lit(name), lit(kind))
    return df.select(*(c.alias(n) for c, n in zip(columns, EVENT_COLUMNS, strict=True)))


def revoked(df: DataFrame) -> DataFrame:
    """Medicare revocations: npi, revoked_dt, reenroll_bar_dt, reason, state, name, kind. Tier A by the grounds cited."""
    grounds = rf"\(A\)\(({'|'.join(map(str, TIER_A_GROUNDS))})\)"
    return _event(df, "MEDICARE_REVOKED", F.col("revoked_dt"), F.col("reenroll_bar_dt"), F.col("reason"), F.col("state"), F.when(F.col("reason").rlike(grounds), "A").otherwise("B"), F.col("name"), F.col("kind"))


def excluded(df: DataFrame) -> DataFrame:
    """Federal exclusions without a waiver: npi, excl_dt, rein_dt, waiver_dt, excltype, general, state, name, kind."""
    reason = F.concat(F.lit("LEIE "), "excltype", F.lit(" ("), F.coalesce("general", F.lit("")), F.lit(")"))
    return _event(df.where("waiver_dt is null"), "OIG_LEIE", F.col("excl_dt"), F.col("rein_dt"), reason, F.col("state"), "A", F.col("name"), F.col("kind"))


def state_excluded(df: DataFrame, keeps_all: str = "TX", since: str = "2018-01-01") -> DataFrame:
    """States' lists: npi, excl_dt, reinstated_dt, eligible_dt, list, state, name, kind. Of the state that keeps everyone it
    ever listed, old rows without an end are tier B."""
    open_ = F.col("reinstated_dt").isNull() & F.col("eligible_dt").isNull() & (F.col("excl_dt") < F.lit(since).cast("date"))
    return _event(df, F.concat(F.lit("STATE_EXCL_"), "state"), F.col("excl_dt"), F.coalesce("reinstated_dt", "eligible_dt"), F.col("list"), F.col("state"), F.when((F.col("state") == keeps_all) & open_, "B").otherwise("A"), F.col("name"), F.col("kind"))


def debarred(df: DataFrame) -> DataFrame:
    """Other agencies' exclusions: npi, agency, active_dt, termination_dt, exclusion_type, code, state, name, kind. Those of
    the agency that has a list of its own are left out."""
    reason = F.concat("exclusion_type", F.lit(" / "), F.coalesce("code", F.lit("")))
    return _event(df.where("agency <> 'HHS'"), F.concat(F.lit("SAM_"), F.coalesce("agency", F.lit("UNKNOWN"))), F.col("active_dt"), F.col("termination_dt"), reason, F.col("state"), "B", F.col("name"), F.col("kind"))


def deactivated(registry: DataFrame) -> DataFrame:
    """Numbers deactivated and not reactivated since: npi, deact_dt, react_dt, state, name, taxonomy."""
    x = registry.where("deact_dt is not null and (react_dt is null or react_dt <= deact_dt)")
    return _event(x, "NPPES_DEACTIVATED", F.col("deact_dt"), F.col("react_dt"), "NPI deactivated in NPPES", F.col("state"), "B", F.col("name"), F.col("taxonomy"))


def latest_status(segments: DataFrame) -> DataFrame:
    """npi, state, status_cd of the last segment in each state: the latest start, then the latest end (open is latest)."""
    order = [F.col("start_dt").desc(), F.coalesce("end_dt", F.lit("9999-01-01").cast("date")).desc(), F.col("segment_id")]
    return top_per_group(segments, ["npi", "state"], order).select("npi", "state", "status_cd")


def deceased(segments: DataFrame, registry: DataFrame, since: str = "2015-01-01", code: str = DECEASED_CODE) -> DataFrame:
    """Persons whose last status in a state is deceased: segments npi, state, start_dt, end_dt, status_cd, segment_id, kind;
    registry npi, entity_type, deact_dt. Tier A if the registry has deactivated the number too."""
    dead = segments.where((F.col("status_cd") == code) & (F.col("start_dt") >= F.lit(since).cast("date")))
    dead = dead.join(latest_status(segments).where(F.col("status_cd") == code), ["npi", "state", "status_cd"], "left_semi")
    x = dead.join(registry.where("entity_type = '1'").select("npi", "deact_dt"), "npi").groupBy("npi", "state", "kind", "deact_dt").agg(F.min("start_dt").alias("first"))
    reason = F.concat(F.lit(f"Medicaid enrollment terminated: provider deceased (T-MSIS status {code})"), F.coalesce(F.concat(F.lit("; NPI deactivated in NPPES "), F.col("deact_dt").cast("string")), F.lit("")))
    return _event(x, "TMSIS_DECEASED", F.col("first"), None, reason, F.col("state"), F.when(F.col("deact_dt").isNotNull(), "A").otherwise("B"), None, F.col("kind"))


def terminated(segments: DataFrame, codes: tuple[str, ...] = TIER_A_CODES) -> DataFrame:
    """Terminations that are the last status in their state: segments as above, with status_desc."""
    x = segments.where(F.col("status_cd").isin(*codes)).join(latest_status(segments), ["npi", "state", "status_cd"], "left_semi")
    x = x.groupBy("npi", "state", "status_cd", "status_desc", "kind").agg(F.min("start_dt").alias("first"))
    return _event(x, F.concat(F.lit("TMSIS_TERM_"), "status_cd"), F.col("first"), None, F.col("status_desc"), F.col("state"), "A", None, F.col("kind"))


def matched_by_name(df: DataFrame) -> DataFrame:
    """List rows without a number, matched to one by name at high confidence: npi, list, event_dt, exclusion_type, state,
    name, same_entity, confidence."""
    x = df.where("same_entity and confidence = 'high'")
    return _event(x, F.concat("list", F.lit("_NAME")), F.col("event_dt"), None, F.concat(F.lit("name-matched by model at high confidence: "), F.coalesce("exclusion_type", F.lit(""))), F.col("state"), "B", F.col("name"), NAME_MATCH)


def released(matches: DataFrame, actions: DataFrame) -> DataFrame:
    """Releases resolved to numbers: matches npi, source_id, source, tier, action_type, event_dt, state, name, title,
    same_entity, confidence, is_subject; actions source_id, category. One for each number, tier and day: that of the
    preferred source, then the smallest source_id."""
    x = matches.where("same_entity and confidence = 'high' and coalesce(is_subject, true) and event_dt is not null").join(actions.select("source_id", "category"), "source_id")
    x = top_per_group(x.withColumn("event_dt", F.to_date("event_dt")), ["npi", "tier", "event_dt"], [F.when(F.col("source") == "DOJ", 0).otherwise(1), F.col("source_id")])
    where = F.when(F.coalesce("category", F.lit("")).ilike("%State Enforcement%"), "STATE_AG").when(F.col("source") == "DOJ", "DOJ").otherwise("OIG")
    outcome = F.when(F.col("tier") == "adjudicated", "_ADJUDICATED").when(F.col("tier") == "alleged", "_CHARGED").otherwise("_ADMIN")
    reason = F.concat(F.lit("enforcement record ("), F.replace("action_type", F.lit("_"), F.lit(" ")), F.lit("): "), F.coalesce("title", F.lit("")))
    return _event(x, F.concat(where, outcome), F.col("event_dt"), None, reason, F.col("state"), F.when(F.col("tier") == "adjudicated", "A").otherwise("B"), F.col("name"), NAME_MATCH)


def list_events(lists: list[DataFrame], registry: DataFrame, valid: Column | None = None) -> DataFrame:
    """All lists' events as EVENT_COLUMNS (missing ones null), distinct, with the registry's name, whether the names agree
    (null where the registry or the list gives none) and how far the identity could be verified. Where names conflict the
    number alone names nobody, so the event is tier C. registry has npi and name, one row per npi."""
    rows = reduce(DataFrame.unionByName, [x.select(*(F.col(c) if c in x.columns else F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS)) for x in lists])
    if valid is not None:
        rows = rows.where(valid)
    rows = rows.where("npi is not null and event_dt is not null").distinct()
    x = rows.join(registry.select("npi", F.col("name").alias("registry_name"), F.lit(True).alias("__known")), "npi", "left")
    agrees = F.when(F.col("__known") & F.col("source_name").isNotNull(), names_agree("source_name", F.coalesce("registry_name", F.lit(""))))
    x = x.withColumn("name_agrees", agrees)
    match = (
        F.when(F.col("source_type") == NAME_MATCH, "name_match_model_high").when(F.col("__known").isNull(), "exact_npi_not_in_nppes").when(F.col("source_name").isNull(), "exact_npi_unnamed_source")
        .when(F.col("name_agrees"), "exact_npi_name_verified").otherwise("exact_npi_name_conflict")
    )
    return x.withColumn("tier", F.when(~F.col("name_agrees"), "C").otherwise(F.col("tier"))).withColumn("id_match", match).drop("__known")


def events_for(events: DataFrame, npis: DataFrame) -> DataFrame:
    """The events of some numbers (a column npi)."""
    return events.join(npis.select("npi").distinct(), "npi", "left_semi")


def paid_after(months: DataFrame, events: DataFrame) -> DataFrame:
    """One row per npi, source and event date with a month paid after it: the best tier, then the most paid."""
    keys = ["npi", "source", "event_dt", "window_end", "reason", "tier"]
    after = month_window_join(months, events, "npi").groupBy(*keys).agg(F.count("*").alias("months_after"), F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"), F.sum("paid_c").alias("after_c"))
    slim = events.select("npi", "source", "event_dt").distinct()
    before = lookback_join(months, slim, "npi").groupBy("npi", "source", "event_dt").agg(F.count("*").alias("months_before"), F.sum("paid_c").alias("before_c"))
    x = after.join(before, ["npi", "source", "event_dt"], "left").na.fill(0, ["months_before", "before_c"])
    return top_per_group(x, ["npi", "source", "event_dt"], [F.col("tier"), F.col("after_c").desc(), F.col("reason")])


def paid_after_score(tier: Column, after: Column, months: Column, before: Column) -> Column:
    """Two for tier A, the magnitude of what was paid, one for persistence, half for a history before."""
    return F.when(tier == "A", 2.0).otherwise(0.0) + F.log10(after + 1) + F.when(months >= 6, 1.0).otherwise(0.0) + F.when(before > 0, 0.5).otherwise(0.0)


def enrolled_after(segments: DataFrame, events: DataFrame, last_day: str, days: int = 90) -> DataFrame:
    """Segments that stay open more than `days` days after the event; open ends are taken as last_day."""
    end = F.coalesce("end_dt", F.lit(last_day).cast("date"))
    x = overlap_join(segments.withColumn("end_dt", end), events, "npi", days)
    return x.groupBy("npi", "source", "event_dt", "tier", "state", "status_cd").agg(F.min("start_dt").alias("seg_start"), F.max("end_dt").alias("seg_end"), F.datediff(F.max("end_dt"), "event_dt").alias("days_active"))


def cross_state(segments: DataFrame, terminated: list, active: list, last_day: str, bulk: float = 0.20, days: int = 90, most_states: int = 3) -> DataFrame:
    """Terminated in one state (by its latest segment there, by a code that isn't a bulk code of that state) and active
    in another more than `days` days later. Providers in many states are left out."""
    s = segments.withColumn("end", F.coalesce("end_dt", F.lit(last_day).cast("date")))
    latest = top_per_group(s, ["npi", "state"], [F.col("start_dt").desc(), F.col("end").desc(), F.col("segment_id")]).select("npi", "state", "status_cd")
    shares = s.groupBy("state", "status_cd").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state"))).where(F.col("share") <= bulk).select("state", "status_cd")
    term = s.where(F.col("status_cd").isin(*terminated)).join(latest, ["npi", "state", "status_cd"], "left_semi").join(shares, ["state", "status_cd"], "left_semi")
    term = term.groupBy("npi", F.col("state").alias("term_state"), F.col("status_cd").alias("term_code")).agg(F.min("start_dt").alias("term_dt"))
    act = s.where(F.col("status_cd").isin(*active)).groupBy("npi", F.col("state").alias("active_state")).agg(F.min("start_dt").alias("active_start"), F.max("end").alias("active_end"))
    foot = s.groupBy("npi").agg(F.countDistinct("state").alias("n_states")).where(F.col("n_states") <= most_states)
    x = term.join(act, "npi").where((F.col("active_state") != F.col("term_state")) & (F.col("active_end") > F.date_add("term_dt", days)))
    return x.join(foot, "npi")


def provider_rollup(events: DataFrame) -> DataFrame:
    """Per npi: first event, sources, name check over all events, and when its window ends (null if one never does)."""
    open_end = F.bool_or(F.col("window_end").isNull())
    return events.groupBy("npi").agg(
        F.min("event_dt").alias("first_event_dt"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n_sources"), F.bool_and(F.coalesce("name_agrees", F.lit(True))).alias("names_agree"),
        F.when(F.bool_and(F.col("id_match") == "exact_npi_name_verified"), "exact_npi_name_verified").otherwise(F.array_join(F.array_sort(F.collect_set("id_match")), ",")).alias("id_match"), F.when(~open_end, F.max("window_end")).alias("window_end"),
    )


def flags(df: DataFrame, detector: str, metric: str, value: str, threshold: float, score: str, dollars: str, evidence: list[str]) -> DataFrame:
    """The generic evidence rows, without their time, which the sink adds."""
    return df.select(flag_id(F.lit(detector), *(F.col(c) for c in evidence)).alias("id"), F.lit(detector).alias("detector"), "npi", F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"), F.lit(threshold).alias("threshold"), F.col(score).alias("score"), F.col(dollars).alias("dollars"), "tier", evidence_json(*evidence).alias("evidence"))


def put_flags(old: DataFrame, new: DataFrame, detector: str) -> DataFrame:
    """The flags of one detector replaced by new ones, one for each id: the one with the most dollars."""
    return replace_slice(old, best_row(new, ["id"], F.struct("dollars", "evidence"), largest=True), "detector", detector)


def provider_paid(rollup: DataFrame, months: DataFrame) -> DataFrame:
    """provider_rollup() with what was paid in the months after the first event and before the window's end: months_after,
    first_month, last_month, after_c; 0 where nothing was."""
    x = month_window_join(months, rollup.select("npi", F.col("first_event_dt").alias("event_dt"), "window_end"), "npi")
    x = x.groupBy("npi").agg(F.count("*").alias("months_after"), F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"), F.sum("paid_c").alias("after_c"))
    return rollup.join(x, "npi", "left").na.fill(0, ["months_after", "after_c"])
