import random

import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.functions import casts, keys
from claimlens.operators.similarity import _jaro_winkler, jaro_winkler_py, similarities, token_set_ratio_py


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def luhn_py(n):
    total = 24
    for i, c in enumerate(n[:9]):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return (10 - total % 10) % 10 == int(n[9])


def test_npi_check_digit(spark):
    good = ["1234567893", "1497364087", "1093316739", "1346979028", "1982736492", "1962546176"]
    rnd = random.Random(3)
    some = good + [f"{rnd.choice('12')}{rnd.randrange(10**9):09d}" for _ in range(2000)]
    rows = spark.createDataFrame([(n,) for n in [*some, None, "", "123", "3234567893"]], "n string").select("n", keys.npi_valid("n").alias("ok")).collect()
    found = {r.n: r.ok for r in rows}
    assert all(found[n] for n in good)
    assert all(found[n] == luhn_py(n) for n in some)
    assert sum(found[n] for n in some) < 400
    assert not any(found[n] for n in (None, "", "123", "3234567893"))


def test_address(spark):
    def k(a, b, z):
        return one(spark, keys.address_keys(F.lit(a), F.lit(b), F.lit(z)))

    x, y = k("6320 Van Nuys Boulevard, Suite 200", None, "91401-1234"), k("6320 VAN NUYS BLVD", "STE 200", "914011234")
    assert x == y
    assert x.building == "6320 VAN NUYS BLVD|91401" and x.unit == "6320 VAN NUYS BLVD|91401#200"
    assert k("6320 Van Nuys Blvd", "Ste 300", "91401").unit.endswith("#300")
    assert k("PO BOX 12", None, "91401").building is None
    assert k("12 Main St", None, None).building is None
    assert k("12 Main St #4", "", "10001").unit == "12 MAIN ST|10001#4"


def test_phone_org_person(spark):
    assert one(spark, keys.phone_key(F.lit("(818) 555-0199"))) == one(spark, keys.phone_key(F.lit("1-818-555-0199"))) == "8185550199"
    assert one(spark, keys.phone_key(F.lit("0000000000"))) is None
    assert one(spark, keys.phone_key(F.lit(None).cast("string"))) is None
    assert one(spark, keys.org_key(F.lit("Sunrise Hospice Care, LLC"))) == one(spark, keys.org_key(F.lit("SUNRISE HOSPICE CARE INC."))) == "SUNRISE HOSPICE CARE"
    assert tuple(one(spark, keys.person_parts(F.lit("Robert"), F.lit("O'Neil-Smith"), F.lit("J")))) == ("ONEILSMITH", "ROBERT", "J")
    assert one(spark, keys.person_parts(F.lit("Robert"), F.lit(None).cast("string"))) is None
    assert one(spark, F.soundex(F.lit("Robert"))) == one(spark, F.soundex(F.lit("Rupert"))) == "R163"
    assert one(spark, F.soundex(F.lit("Tymczak"))) == "T522"
    assert one(spark, keys.not_placeholder(F.lit("n/a"))) is None


def test_text(spark):
    assert one(spark, keys.clean_text(F.lit("before — after"))) == "before, after"
    assert one(spark, keys.clean_text(F.lit("2019–2024"))) == "2019 to 2024"
    assert one(spark, keys.action_type(F.lit("Owner pleads guilty"))) == "pleaded_guilty"
    assert one(spark, keys.action_type(F.lit("News"), F.lit("The clinic was excluded"))) == "exclusion"
    assert one(spark, keys.largest_dollars(F.lit("paid $1.5 million of $900,000"))) == 1.5e6
    assert one(spark, keys.is_subject(F.lit("former Employer of")))  is False
    assert one(spark, keys.event_key(F.lit(None).cast("string"), F.lit("HTTPS://A.b/c//"))) == "https://a.b/c"
    assert one(spark, keys.names_agree(F.lit("Sunrise Care Inc"), F.lit("SUNRISE GROUP")))
    assert not one(spark, keys.names_agree(F.lit("Care Inc"), F.lit("Care LLC")))
    assert one(spark, keys.money_short(F.lit(3_400_000.0))) == "$3.4M"


def test_casts(spark):
    day = lambda s: str(one(spark, casts.to_day(F.lit(s))))
    assert day("2/3/2020") == day("2020-02-03") == day("20200203") == "2020-02-03"
    assert day("00000000") == day("9999-12-30") == day("x") == "None"
    assert one(spark, casts.to_long(F.lit("1.5"))) == 2 and one(spark, casts.to_long(F.lit("a"))) is None
    assert one(spark, casts.safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, casts.evidence_json(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))) == '{"a":1,"b":null}'


def test_sql_functions(spark):
    keys.register_sql(spark)
    r = spark.sql("select npi_valid('1234567893') a, names_agree('Acme Hospice', 'ACME LLC') b, list_org_key('The Acme, Inc.') c").first()
    assert r.a and r.b and r.c == "ACME"


def test_similarity():
    assert abs(jaro_winkler_py("MARTHA", "MARHTA") - 0.9611) < 1e-3
    assert jaro_winkler_py("", "A") == 0 and jaro_winkler_py("A", "A") == 1
    assert token_set_ratio_py("sunrise hospice care", "care sunrise hospice llc") == 100
    assert token_set_ratio_py("", "x") == 0


def test_validators_and_dates(spark):
    assert one(spark, keys.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) and not one(spark, keys.is_uuid(F.lit("x")))
    assert one(spark, keys.is_cluster_id(F.lit("N-0012"))) and not one(spark, keys.is_cluster_id(F.lit(None).cast("string")))
    assert not one(spark, keys.is_decision(F.lit("maybe")))
    assert one(spark, keys.district_state(F.lit("Southern District of Texas"), {"Texas": "TX", "New York": "NY"})) == "TX"
    assert one(spark, keys.district_state(F.lit("elsewhere"), {"Texas": "TX"})) is None
    assert [str(one(spark, keys.press_date(F.lit(d)))) for d in ("Jan. 5, 2024", "January 5, 2024", "Sept. 3, 2023", "soon")] == ["2024-01-05", "2024-01-05", "2023-09-03", "None"]


def test_release_texts(spark):
    assert one(spark, keys.district_state(F.lit("USAO - Florida, Southern"))) == "FL"
    assert one(spark, keys.district_state(F.lit("USAO - District of Columbia"))) == "DC" == one(spark, keys.district_state(F.lit("District of Columbia")))
    assert one(spark, keys.district_state(F.lit("Criminal Division"))) is None
    body = "Owners of Golden Sun Hospice, Inc. and Bright Path Home Health LLC were named. Medical Fraud Scheme Pharmacy. golden clinic."
    assert one(spark, keys.company_names(F.lit(body))) == ["Golden Sun Hospice, Inc", "Bright Path Home Health LLC"]
    assert one(spark, keys.company_names(F.lit(None).cast("string"))) == []
    assert one(spark, keys.pretty_source(F.lit("MEDICARE_REVOKED,STATE_EXCL_TX,SAM_OPM_X,DOJ_CHARGED,OTHER_LIST"))) == "the Medicare revocation list and the TX Medicaid exclusion list and the SAM.gov exclusion list (OPM X) and a Department of Justice release and other list"
    assert one(spark, keys.reason_list(F.lit("over the cap in 2 month(s); paid in 1 months.; ;"))) == ["Over the cap in 2 months.", "Paid in 1 month."]
    rules = {"sentenced": "Owner sentenced", "convicted": "jury finds owner", "civil_judgment": "a judgment", "civil_settlement": "to pay $5", "indicted": "indictment", "arrested": "arrested", "charged": "charges filed", "complaint": "complaint", "exclusion": "exclusion", "payment_suspension": "suspended", "license_action": "license", "other": "news"}
    assert {one(spark, keys.action_type(F.lit(t))): t for t in rules.values()} == rules


def test_flag_ids(spark):
    df = spark.range(1000).select(casts.flag_id(F.lit("D3"), F.col("id")).alias("i"))
    assert df.where("i < 0").count() == 0 and df.distinct().count() == 1000


def test_jaro_winkler_in_batches():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(rnd.choice(("ab", "abcé", "0123"))) for _ in range(rnd.choice((0, 1, 2, 5, 9, 9, 12, 70))))
    pairs = [(word(), word()) for _ in range(3000)] + [(None, "a"), ("a", None), ("", ""), ("x", "x")]
    for some in (pairs, [("000000123", "000003210"), ("123456789", "987654321")], [p for p in pairs if p[0] and p[1] and (p[0] + p[1]).isascii()], []):
        got = _jaro_winkler(*(pa.array([p[i] for p in some], pa.string()) for i in (0, 1))).to_pylist()
        assert got == [None if a is None or b is None else jaro_winkler_py(a, b) for a, b in some]


def test_similarities_compare_a_pair_of_names_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def measure(a, b):
        @F.udf("double")
        def f(x, y):
            seen.add(1)
            return None if x is None or y is None else float(x == y)

        return f(a, b)

    left = spark.range(60).select(F.col("id").alias("l"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 6 != 5, F.concat(F.lit("n"), F.col("id") % 6)).alias("a"))
    right = spark.range(40).select(F.col("id").alias("r"), (F.col("id") % 2).alias("k"), F.concat(F.lit("n"), F.col("id") % 4).alias("b"))
    got = sorted(map(tuple, similarities(left, right, "l", "r", "k", "a", "b", measure).collect()), key=repr)
    assert got == sorted(((i, j, None if i % 6 == 5 else float(i % 6 == j % 4)) for i in range(60) for j in range(40) if i % 2 == j % 2), key=repr)
    assert seen.value == 12
