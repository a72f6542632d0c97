"""Point queries over published tables: claim checks, search, profiles, evidence, rollups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.keys import US_STATES, npi_shape, trigram_similarity
from claimlens.operators.temporal import day_window_join

def verify_claims(claims: DataFrame, events: DataFrame) -> DataFrame:
    """One row per claim (id, start, end, npis, paid): flagged and its hits. A claim is hit by an event of one of its
    NPIs when its service day is after the event and not after the end of its window. Events repeated by several lists
    count once."""
    npis = claims.select(F.col("id").alias("claim_id"), F.to_date(F.coalesce("start", "end")).alias("service_dt"), F.explode(F.array_distinct("npis")).alias("npi")).where(npi_shape("npi") | F.col("npi").cast("string").isNotNull())
    hits = day_window_join(npis, events.select("npi", "source", "event_dt", "window_end").distinct(), "npi")
    hits = hits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("npi", "event_dt", "source"))).alias("hits"))  # of one claim
    x = claims.join(hits, F.col("id") == F.col("claim_id"), "left")
    return x.select("id", "paid", F.coalesce(F.size("hits") > 0, F.lit(False)).alias("flagged"), "hits")


def verify_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("claims"), F.count_if("flagged").alias("flagged"), F.sum(F.when(F.col("flagged"), F.col("paid"))).alias("flagged_paid"))


def parse_query(text: str) -> dict:
    """npi, state, city and name of a search box's text. Ten digits are a number and nothing else counts; a state stands at
    the end, as its name or code; a city stands after "in", or after the last comma if it is of up to three words."""
    t = " ".join(text.split())
    out: dict = {"npi": None, "state": None, "city": None, "name": None}
    if m := re.search(r"\b\d{10}\b", t):
        return out | {"npi": m[0]}
    for name, code in sorted(US_STATES.items(), key=lambda x: -len(x[0])):
        if m := re.search(rf"(?:^|,\s*|\s+){name}\s*$", t, re.I):
            out["state"], t = code, t[: m.start()].strip()
            break
    if not out["state"] and (m := re.search(r"(?:,\s*|\s+)([A-Za-z]{2})\s*$", t)) and m[1].upper() in US_STATES.values() and len(t[: m.start()].strip()) >= 2:
        out["state"], t = m[1].upper(), t[: m.start()].strip()
    if m := re.match(r"(.*?)\s+in\s+([A-Za-z .'-]{2,})$", t, re.I):
        t, out["city"] = m[1].strip(), m[2].strip()
    else:
        parts = [x.strip() for x in t.split(",") if x.strip()]
        if 2 <= len(parts) <= 3 and len(parts[-1].split()) <= 3:
            out["city"] = parts.pop()
            t = ", ".join(parts)
    out["name"] = " ".join(re.sub(r"[^\w &'.,-]", " ", t).split()).strip(" ,") or None
    return out


def search(registry: DataFrame, text: str, limit: int = 25, least: float = 0.25) -> DataFrame:
    """Registry rows (npi, name, city, state) by number prefix, else by fuzzy name within the state and city named."""
    q = parse_query(text)
    if q["npi"] or re.fullmatch(r"\d{3,10}", text.strip()):
        return registry.where(F.col("npi").cast("string").startswith(q["npi"] or text.strip())).withColumn("similarity", F.lit(1.0)).orderBy("npi").limit(limit)
    x = registry
    for k in ("state", "city"):
        if q[k]:
            x = x.where(F.upper(k) == q[k].upper())
    return x.withColumn("similarity", trigram_similarity(F.lit(q["name"] or ""), F.col("name"))).where(F.col("similarity") > least).orderBy(F.col("similarity").desc(), "npi").limit(limit)


def profile(registry: DataFrame, npi, blocks: dict[str, DataFrame]) -> DataFrame:
    """One registry row with each block's rows as a list, for one npi; the filter reaches every scan."""
    x = registry.where(F.col("npi") == npi)
    for name, df in blocks.items():
        cols = [c for c in df.columns if c != "npi"]
        rows = df.where(F.col("npi") == npi).groupBy("npi").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        x = x.join(rows, "npi", "left")
    return x


def evidence_lines(parts: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    """(subject, line, source, statement), lines numbered by source and statement within the subject."""
    from functools import reduce

    from pyspark.sql.window import Window

    x = reduce(DataFrame.unionByName, [df.select(F.col("npi").alias("subject"), F.lit(source).alias("source"), s.alias("statement")) for df, source, s in parts]).where("statement is not null")
    return x.withColumn("line", F.row_number().over(Window.partitionBy("subject").orderBy("source", "statement")))


# Regulations (of title 42) by the kind of evidence, in order.
GROUNDS = {
    "MEDICARE_REVOKED_PAID_AFTER": ("455.416(c)", "455.436", "455.23", "424.535(a)"),
    "OIG_LEIE_PAID_AFTER": ("1001.1901", "455.436", "455.23", "1003.200"),
    "STATE_EXCL_PAID_AFTER": ("455.416(c)", "455.436", "455.23"),
    "SAM_PAID_AFTER": ("455.436", "1001.1901"),
    "NPPES_DEACTIVATED_PAID_AFTER": ("455.436", "455.416(d)"),
    "CROSS_STATE_TERMINATION": ("455.416(c)", "455.436"),
    "IMPOSSIBLE_HOURS": ("455.23", "1003.200", "455.410"),
    "PER_PATIENT_IMPOSSIBLE": ("455.23", "1003.200"),
    "MN_DAILY_CAP": ("455.23", "1003.200"),
    "UMBRELLA_VOLUME": ("455.410", "455.104"),
    "NETWORK_SHARED_OWNERS": ("455.104", "455.432", "455.450", "424.518"),
    "NETWORK_SHARED_ADDRESS": ("455.432", "455.416(g)", "455.450"),
    "NETWORK_INCORPORATION_BURST": ("455.450", "455.432", "424.518"),
    "NETWORK_OWNER_ON_LEIE": ("1001.1901", "455.416(b)", "455.104"),
    "NETWORK_ADDRESS_OF_REVOKED_ENTITY": ("455.416(c)", "455.432", "455.416(g)"),
    "NETWORK_MEMBER_ON_LIST": ("455.416(c)", "1001.1901", "455.436"),
}
NO_GROUNDS = ("455.410",)
#: What a reader of a kind of evidence should keep in mind.
CAVEATS = {
    "UMBRELLA_VOLUME": "Staff of one organization are often billed under a supervisor, which can be lawful: ask for records.",
    "NETWORK_SHARED_OWNERS": "Owning several providers is ordinary; it matters together with other signs only.",
    "NETWORK_SHARED_ADDRESS": "Office buildings and agents' addresses have many tenants; an address proves nothing on its own.",
    "NETWORK_INCORPORATION_BURST": "Companies are also founded in groups when a business grows.",
    "NETWORK_OWNER_ON_LEIE": "Owners are matched by name: confirm the person first.",
    "NETWORK_ADDRESS_OF_REVOKED_ENTITY": "What happened to an earlier tenant says nothing about this one.",
    "NETWORK_MEMBER_ON_LIST": "One member's listing doesn't extend to the others.",
}
SCREENING = "Screening only: verify every fact against its source before acting on it."


def grounds(kinds: Column) -> Column:
    """Distinct regulations of a list of evidence kinds, in order; the screening rule where there is none."""
    table = F.create_map(*[x for k, v in GROUNDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.array_distinct(F.flatten(F.filter(F.transform(kinds, lambda k: F.element_at(table, k)), lambda a: a.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, NO_GROUNDS)))


def flag_kind(detector: Column, source: Column, label: Column) -> Column:
    """The kind of evidence of a detector's flag: by the list of a payment after it, or by the label of a month's volume."""
    listed = (
        F.when(source.isin("MEDICARE_REVOKED", "OIG_LEIE", "NPPES_DEACTIVATED"), F.concat(source, F.lit("_PAID_AFTER")))
        .when(source.startswith("STATE_EXCL"), "STATE_EXCL_PAID_AFTER").when(source.startswith("SAM"), "SAM_PAID_AFTER")
    )
    volume = (
        F.when(label == "IMPOSSIBLE_PER_PATIENT", "PER_PATIENT_IMPOSSIBLE").when(label.isin("EXCEEDS_DAILY_CAP", "EXCEEDS_MN_DAILY_CAP"), "MN_DAILY_CAP")
        .when(label.startswith("IMPOSSIBLE"), "IMPOSSIBLE_HOURS").when(label == "UMBRELLA_VOLUME", "UMBRELLA_VOLUME")
    )
    return F.when(detector == "D3", listed).when(detector == "D2", volume)


def network_kinds(owner_multi: Column, addr_share: Column, unit_share: Column, phone_share: Column, burst_90: Column, owner_lists: Column, address_hits: Column, listed_members: Column) -> Column:
    """The kinds of evidence of a network's features; owner_lists: the lists that owners' names are on."""
    most = F.greatest(F.coalesce(addr_share, F.lit(0)), F.coalesce(unit_share, F.lit(0)), F.coalesce(phone_share, F.lit(0)))
    named = F.coalesce(F.arrays_overlap(owner_lists, F.array(F.lit("OIG_LEIE"), F.lit("SAM"))), F.lit(False))
    found = [
        (owner_multi >= 1, "NETWORK_SHARED_OWNERS"), (most >= 2, "NETWORK_SHARED_ADDRESS"), (burst_90 >= 3, "NETWORK_INCORPORATION_BURST"), (named, "NETWORK_OWNER_ON_LEIE"), (address_hits > 0, "NETWORK_ADDRESS_OF_REVOKED_ENTITY"), (listed_members > 0, "NETWORK_MEMBER_ON_LIST"),
    ]
    return F.filter(F.array(*(F.when(c, n) for c, n in found)), lambda x: x.isNotNull())


def packet(lines: DataFrame, kinds: DataFrame, most: int = 30) -> DataFrame:
    """One packet for each subject: summary (its first line), findings (text and the id of the line it cites, the next `most`
    lines), evidence (all lines with their ids), evidence_kinds, grounds and caveats. lines: see evidence_lines; kinds:
    subject, kinds (array)."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("line") - 1).alias("id"), "source", "statement")))  # of one subject
    x = lines.groupBy("subject").agg(rows.alias("evidence")).join(kinds, "subject", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    known = F.create_map(*[y for k, v in CAVEATS.items() for y in (F.lit(k), F.lit(v))])
    notes = F.filter(F.transform("kinds", lambda k: F.element_at(known, k)), lambda c: c.isNotNull())
    findings = F.transform(F.slice("evidence", 2, most), lambda e: F.struct(e["statement"].alias("text"), F.array(e["id"]).alias("evidence_ids")))
    return x.select("subject", F.col("evidence")[0]["statement"].alias("summary"), findings.alias("findings"), "evidence", F.col("kinds").alias("evidence_kinds"), grounds(F.col("kinds")).alias("grounds"), F.concat(F.array(F.lit(SCREENING)), notes).alias("caveats"))


def subject_numbers(members: DataFrame, subject: str, is_network: bool) -> DataFrame:
    """The numbers (npi) that a question about a subject is about: a network's members, or the provider's own."""
    if is_network:
        return members.where(F.col("community") == subject).select("npi").distinct()
    return members.sparkSession.createDataFrame([(subject,)], "npi string").select(F.col("npi").cast(members.schema["npi"].dataType).alias("npi"))


def subject_tools(tables: dict[str, DataFrame], subject: str, is_network: bool, members_limit: int = 60, owners_limit: int = 120, rows_limit: int = 200) -> dict[str, DataFrame]:
    """Six selections for questions about a network or a provider: subject, members, owners, list_actions,
    payment_timeline and saturation. tables: networks (community, place), risk (npi, place), members (community, npi, paid),
    owners (community, npi, ...), actions (npi, event_dt, ...), flags (npi, month, ...) and saturation (place, ...)."""
    npis = subject_numbers(tables["members"], subject, is_network)
    mine = lambda df: df.join(F.broadcast(npis), "npi", "left_semi")  # noqa: E731  (the members of one network)
    about = tables["networks"].where(F.col("community") == subject) if is_network else mine(tables["risk"])
    inside = tables["members"].where(F.col("community") == subject).orderBy(F.col("paid").desc_nulls_last(), "npi").limit(members_limit) if is_network else mine(tables["members"])
    owners = tables["owners"].where(F.col("community") == subject) if is_network else mine(tables["owners"])
    return {
        "subject": about, "members": inside, "owners": owners.orderBy(*owners.columns).limit(owners_limit), "list_actions": mine(tables["actions"]),
        "payment_timeline": mine(tables["flags"]).orderBy("month", "npi").limit(rows_limit), "saturation": tables["saturation"].join(F.broadcast(about.select("place").distinct()), "place", "left_semi"),
    }


def top_of_place(risk: DataFrame, place: str, value, k: int = 8, unique: str = "npi") -> DataFrame:
    """The k best ranked of a place; of equal ranks those with the smallest number."""
    return risk.where(F.col(place) == value).orderBy("rank", unique).limit(k)


def area_context(risk: DataFrame, who: DataFrame, scopes: list[str], least: int = 3) -> DataFrame:
    """For each provider of who (npi and the columns in scopes, the narrowest first): the narrowest scope in which at least
    `least` rows of risk are, else the widest; how many others there, their dollars and the most frequent detector."""
    out = who
    for s in scopes:
        n = risk.groupBy(s).agg(F.count("*").alias(f"__n_{s}"))
        out = out.join(n, s, "left")
    pick = F.lit(scopes[-1])
    for s in reversed(scopes[:-1]):
        pick = F.when(F.coalesce(f"__n_{s}", F.lit(0)) >= least, s).otherwise(pick)
    out = out.withColumn("scope", pick)
    parts = []
    for s in scopes:
        by = risk.groupBy(s).agg(F.count("*").alias("__n"), F.sum("dollars_c").alias("__c"))
        det = risk.select(s, F.explode("detectors").alias("d")).groupBy(s, "d").agg(F.count("*").alias("m")).groupBy(s).agg(F.min_by("d", F.struct(-F.col("m"), F.col("d"))).alias("detector"))
        own = risk.select("npi", F.lit(1).alias("__own"), F.col("dollars_c").alias("__own_c"))
        x = out.where(F.col("scope") == s).join(by, s, "left").join(det, s, "left").join(own, "npi", "left")
        others = F.coalesce("__n", F.lit(0)) - F.coalesce("__own", F.lit(0))
        parts.append(x.select("npi", "scope", F.col(s).cast("string").alias("area"), others.alias("others"), (F.coalesce("__c", F.lit(0)) - F.coalesce("__own_c", F.lit(0))).alias("dollars_c"), "detector"))
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


def tier_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("tier").agg(F.count("*").alias("n"), F.sum("dollars_c").alias("dollars_c"), F.count_if(F.col("n_strong") >= 2).alias("corroborated"))


def case_profiles(cases: DataFrame, registry: DataFrame, tables: dict[str, DataFrame], most: int = 6) -> DataFrame:
    """For known cases (case, pattern in capitals, state): the registry's rows whose name has the pattern (up to `most`, by
    number), and in which tables (with npi) any of them is found, comma-joined; null without a row."""
    import functools

    from claimlens.operators.ranking import top_per_group

    names = registry.select("npi", F.upper("name").alias("__name"), "state")
    # cases are a short list given by hand
    hit = names.join(F.broadcast(cases), "state").where(F.col("__name").contains(F.col("pattern"))).select("case", "npi")
    hit = top_per_group(hit, ["case"], [F.col("npi")], most)
    seen = functools.reduce(DataFrame.unionByName, [df.select("npi").distinct().select("npi", F.lit(n).alias("found")) for n, df in tables.items()])
    g = hit.join(seen, "npi", "left").groupBy("case").agg(F.countDistinct("npi").alias("npis"), F.array_join(F.array_sort(F.collect_set("found")), ",").alias("found"))
    return cases.select("case").join(g, "case", "left").select("case", F.coalesce("npis", F.lit(0)).alias("npis"), "found")


def scaled(df: DataFrame, value: str, name: str) -> DataFrame:
    """0 to 100 between the smallest and the largest value; 0 if they are the same."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = df.crossJoin(F.broadcast(ends))  # one row
    return x.withColumn(name, F.coalesce(100 * F.try_divide((F.col(value) - F.col("__lo")).cast("double"), F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def checks(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """table, rows, least, ok for tables that must have at least so many rows."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(least).cast("long").alias("least"), (F.col("rows") >= least).alias("ok")) for n, (df, least) in tables.items()])
