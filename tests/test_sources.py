import json

from claimlens.sources import readers, writers
from claimlens.streaming import feed


def test_readers(spark, tmp_path):
    (tmp_path / "a_2021.csv").write_text("id,NAME\n001,x\n002,\"y, z\"\n")
    (tmp_path / "b_2022.csv").write_text("id,extra\n003,q\n")
    x = readers.union_files(spark, [f"{tmp_path}/a_2021.csv", f"{tmp_path}/b_2022.csv"])
    assert {(r.id, r.NAME, r.extra, r.file_year) for r in x.collect()} == {("001", "x", None, 2021), ("002", "y, z", None, 2021), ("003", None, "q", 2022)}
    assert [r.name for r in readers.project(x, {"name": "name", "gone": "no"}).orderBy("name").collect()][-1] == "y, z"
    assert readers.newest(spark, f"{tmp_path}/*_20*.csv").endswith("b_2022.csv")
    assert readers.columns_like(x, "^ex") == ["extra"]
    (tmp_path / "t.txt").write_text("H0001 ... 12.50\nnoise\nH0002 ... 7\n")
    assert [(r.code, r.rate) for r in readers.lines_by_pattern(spark, f"{tmp_path}/t.txt", r"^(H\d+)\s.*?([\d.]+)$", ["code", "rate"]).orderBy("code").collect()][0][0] == "H0001"
    (tmp_path / "mixed.txt").write_bytes("café\n".encode() + "naïve\n".encode("cp1252"))
    assert sorted(r.value for r in readers.repaired_text(spark, f"{tmp_path}/mixed.txt").collect()) == ["café", "naïve"]
    assert readers.table_or_empty(spark, "no_such_table", "a int, b string").count() == 0


def test_delimited_kinds(spark, tmp_path):
    (tmp_path / "bar.txt").write_text("a|b\n1|x\n2|y\n")
    assert [tuple(r) for r in readers.delimited(spark, f"{tmp_path}/bar.txt", "|").orderBy("a").collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "tab.txt").write_bytes("a\tb\n1\tcafé\n".encode("latin-1"))
    assert readers.delimited(spark, f"{tmp_path}/tab.txt", "\t", encoding="ISO-8859-1").first().b == "café"
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n2\n3,y,z\n4,w\n")
    rows = readers.delimited(spark, f"{tmp_path}/bad.csv", skip_malformed=True, schema="a string, b string").collect()
    assert [tuple(r) for r in rows] == [("1", "x"), ("4", "w")]
    (tmp_path / "multi.csv").write_text('a,b\n1,"two\nlines, ""quoted"""\n')
    assert readers.delimited(spark, f"{tmp_path}/multi.csv", multi_line=True).first().b == 'two\nlines, "quoted"'
    for y in (2019, 2020):
        (tmp_path / f"y{y}.csv").write_text(f"id\n{y}\n")
    got = readers.union_files(spark, f"{tmp_path}/y20*.csv")
    assert {(r.id, r.file_year, r.filename) for r in got.collect()} == {("2019", 2019, "y2019.csv"), ("2020", 2020, "y2020.csv")}
    assert readers.with_columns(got, {"id": "string", "extra": "date"}).dtypes[-1] == ("extra", "date")
    assert readers.with_columns(got, {"ID": "string"}).columns == got.columns


def test_bundle(spark):
    code = lambda c, system="s": {"coding": [{"system": system, "code": c}]}
    npi = lambda v, c="npi": {"identifier": {"value": v, "type": code(c)}}
    base = {"resourceType": "ExplanationOfBenefit", "billablePeriod": {"start": "2024-01-02T00:00:00", "end": "2024-01-03"}}
    r1 = base | {
        "id": "e1", "type": {"coding": [{"system": "x", "code": "71"}, {"system": "https://b/eob-type", "code": "CARRIER"}]}, "careTeam": [{"provider": npi("1234567893")}, {"provider": npi("1111111111", "upin")}, {"provider": {"identifier": {"value": "2222222222"}}}],
        "provider": {"identifier": {"system": "us-npi", "value": "3333333333"}}, "contained": [{"identifier": [{"system": "us-npi", "value": "1093316739"}, {"system": "other", "value": "4444444444"}, {"value": "5555555555", "type": code("NPI")}]}],
        "total": [{"category": code("submitted"), "amount": {"value": 99}}, {"category": code("benefit"), "amount": {"value": 9.5}}], "item": [{"productOrService": {"coding": [{"code": "H0001"}, {}]}}, {"productOrService": code("H0002")}], "diagnosis": [{"diagnosisCodeableConcept": code("I10")}],
    }
    r2 = base | {"id": "e2", "type": code("40"), "payment": {"amount": {"value": 7}}, "total": [{"category": code("benefit"), "amount": {"value": 1}}]}
    r3 = base | {"id": "e3", "item": [{"adjudication": [{"category": code("line_pmt_amt"), "amount": {"value": 1.25}}, {"category": code("paidtoprovider"), "amount": {"value": 2}}, {"category": code("submitted"), "amount": {"value": 50}}]}]}
    r4 = base | {"id": "e4"}
    bundle = {"entry": [{"resource": r} for r in (r1, r2, r3, r4, {"resourceType": "Patient"})]}
    df = spark.createDataFrame([(json.dumps(bundle),), (None,), ("{",)], "b string")
    got = {r.id: r for r in readers.claims_from_bundles(df, "b").collect()}
    assert sorted(got) == ["e1", "e2", "e3", "e4"]
    assert (got["e1"].type, str(got["e1"].start), got["e1"].paid, got["e1"].codes, got["e1"].diagnoses) == ("CARRIER", "2024-01-02", 9.5, ["H0001", "H0002"], ["I10"])
    assert got["e1"].npis == ["1093316739", "1234567893", "2222222222", "3333333333", "5555555555"]
    assert (got["e2"].type, got["e2"].paid, got["e3"].paid, got["e4"].paid) == ("40", 7.0, 3.25, None) and got["e4"].npis == []


def test_html(spark):
    df = spark.createDataFrame([("<p>a <b>b</b></p><script>x<y</script>\n c",), (None,)], "h string")
    assert [r[0] for r in df.select(readers.strip_html("h")).collect()] == ["a b c", None]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 1234)], "id int, k string, n int")
    p = f"{tmp_path}/t"
    writers.replace(df, p, partition=["k"])
    writers.replace_partition(spark.createDataFrame([(9, 1, "a")], "id int, n int, k string"), p, "k")
    assert {(r.id, r.k) for r in spark.read.parquet(p).collect()} == {(9, "a"), (2, "b")}
    writers.replace(df, f"{tmp_path}/u")
    new = writers.upsert(spark.createDataFrame([(2, "B", 0)], "id int, k string, n int"), f"{tmp_path}/u", ["id"])
    assert {(r.id, r.k) for r in spark.read.parquet(new).collect()} == {(1, "a"), (2, "B")}
    assert json.loads(writers.snapshot(df, ["id"], 1)) == [{"id": 1, "k": "a", "n": 5}]
    assert "1,234" in writers.markdown_table(df)
    t = writers.replace_section("# T\n\n## A\n\nold\n\n## B\n\nb", "A", "new")
    assert "old" not in t and "new" in t and "## B" in t
    assert json.loads(writers.summary({"x": df.limit(1)}))["x"][0]["id"] == 1
    for _ in range(2):
        writers.append_json_lines(df, f"{tmp_path}/lines")
    assert readers.json_lines(spark, f"{tmp_path}/lines", "id int, k string, n int").count() == 4
    writers.append(df, f"{tmp_path}/u")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 4
    writers.export_csv(df, f"{tmp_path}/csv")
    assert readers.delimited(spark, f"{tmp_path}/csv").count() == 2
    assert [f.name for f in (tmp_path / "t").rglob("*.zstd.parquet")]


def test_feed(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    (tmp_path / "in").mkdir()

    def row(i, source, url, published="2024-01-05", body="b", fetched="2024-01-06T00:00:00"):
        return json.dumps({"source": source, "source_id": i, "url": url, "title": f"t{i}", "published": published, "body": body, "fetched_at": fetched})

    (tmp_path / "in/1.json").write_text("\n".join([row("a", "OIG", "http://x/1", body="long body"), row("b", "DOJ", "http://x/1/"), row("c", "OIG", "http://x/2")]))
    feed.run(feed.once(feed.read_feed(spark, src)), store, ck).awaitTermination()
    assert sorted((r.event_key, r.source_id) for r in spark.read.parquet(store).collect()) == [("http://x/1", "b"), ("http://x/2", "c")]
    (tmp_path / "in/2.json").write_text("\n".join([row("c", "OIG", "http://x/2"), row("d", "OIG", "http://x/3")]))
    feed.run(feed.once(feed.read_feed(spark, src)), store, ck).awaitTermination()
    assert sorted(r.source_id for r in spark.read.parquet(store).collect()) == ["b", "c", "d"]
    assert str(feed.since(spark, store)) == "2024-01-02" and feed.since(spark, f"{tmp_path}/none") is None
    assert str(feed.since(spark, store, daily_days=7, today="2024-03-08")) == "2024-03-01"


def test_chain_stops_at_the_first_failure():
    ran = []

    def fail():
        raise RuntimeError("no")

    assert feed.chain([("a", lambda: ran.append("a"))], lambda: ran.append("p")) == ["a", "publish"] and ran == ["a", "p"]
    try:
        feed.chain([("a", lambda: ran.append("b")), ("f", fail), ("c", lambda: ran.append("c"))], lambda: ran.append("p"))
    except RuntimeError:
        pass
    assert ran == ["a", "p", "b"]
