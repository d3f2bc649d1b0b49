import datetime

from pyspark.sql import functions as F

from plumbline.sources import tables
from plumbline.streaming import incremental


def test_yearly_metadata_reads_only_wanted_years(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "title string, n int").write.parquet(str(tmp_path / "year=2019"))
    spark.createDataFrame([("b", "x")], "title string, court string").write.parquet(str(tmp_path / "year=2020"))
    spark.createDataFrame([("c",)], "title string").write.parquet(str(tmp_path / "year=2022"))
    got = tables.yearly_metadata(spark, str(tmp_path), 2019, 2021)
    assert sorted((r["title"], r["_year"]) for r in got.collect()) == [("a", 2019), ("b", 2020)]
    assert {"court", "n"} <= set(got.columns)
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()
    assert tables.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (None, "a"), (2, "b")], "n int, `s t` string")
    got = {r["column"]: r for r in tables.profile(df).collect()}
    assert (got["n"]["n_null"], got["n"]["n_values"], got["n"]["kind"], got["n"]["samples"]) == (1, 3, "int", ["1", "2", "2"])
    assert got["s t"]["samples"] == ["b", "a", "b"]


def test_profile_finds_the_first_values_in_one_scan(spark):
    import random

    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, None, "x" * 50, "y"]), rnd.choice([None, float(k)]), None) for k in range(20_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, s string, d double, place string").repartition(7)
    got = {r["column"]: r for r in tables.profile(df, place=F.col("k")).collect()}
    for name, at in (("k", 0), ("s", 1), ("d", 2), ("place", 3)):
        values = [str(r[at])[:40] for r in sorted(rows) if r[at] is not None]
        assert (got[name]["n_values"], got[name]["n_null"], got[name]["samples"]) == (len(values), 20_000 - len(values), values[:3])
    assert [r["column"] for r in tables.profile(df).collect()] == ["k", "s", "d", "place"]
    none = tables.profile(df.limit(0)).collect()
    assert [(r["n_values"], r["samples"]) for r in none] == [(0, [])] * 4
    assert tables.profile_json(tables.profile(df.limit(0))).first()["json"] == '{"kind":"bigint","n_null":0,"n_values":0,"samples":[]}'


def test_batches_of_upserts_give_the_rebuilt_table(spark, tmp_path):
    import random

    rnd, path, state = random.Random(9), str(tmp_path / "t"), {}
    for number in range(4):
        rows = [(rnd.choice([None, *(f"k{i}" for i in range(40))]), number * 1000 + i, f"v{number}.{i}") for i in range(60)]
        batch = spark.createDataFrame(rows, "id string, version long, v string").repartition(3)
        tables.upsert(spark, path, batch, "id", "version", buckets=8)
        for row in sorted(rows, key=lambda r: r[1]):
            state[row[0]] = row
        assert sorted(map(tuple, tables.stored(spark, path).collect()), key=str) == sorted(state.values(), key=str)
    tables.upsert(spark, path, batch, "id", "version", buckets=8)  # once more: nothing changes
    assert sorted(map(tuple, tables.stored(spark, path).collect()), key=str) == sorted(state.values(), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = tmp_path / "t"
    tables.upsert(spark, str(path), spark.range(200).selectExpr("id", "'old' AS v"), "id", buckets=16)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    tables.upsert(spark, str(path), spark.createDataFrame([(5, "new", 1.5)], "id long, v string, extra double"), "id", buckets=16)
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len(before) == 16 and len([p for p in before if after.get(p) == before[p]]) == 15
    got = {r["id"]: (r["v"], r["extra"]) for r in tables.stored(spark, str(path)).collect()}
    assert len(got) == 200 and got[5] == ("new", 1.5) and got[6] == ("old", None)


def test_following_a_folder_with_replacements(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame([(i, v) for i, v in pairs], "chunk_id string, v int")
    source, index, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    for batch in ([("a", 1), ("b", 1)], [("b", 2), ("b", 3), ("c", 1)]):
        rows(*batch).write.mode("append").parquet(source)
        incremental.follow(spark, source, "chunk_id string, v int", index, check, version="v", replace=True).awaitTermination()
    assert sorted(map(tuple, tables.stored(spark, index).collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_pdf_pages_with_a_reader(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"one|two||")
    (tmp_path / "bad.pdf").write_bytes(b"!")
    (tmp_path / "no.txt").write_bytes(b"x")

    def reader(data):
        if data == b"!":
            raise ValueError("damaged")
        return data.decode().split("|")

    got = sorted((r["pdf_path"].rsplit("/")[-1], r["page_number"] or 0, r["text"], r["error"]) for r in tables.pdf_pages(spark, str(tmp_path), reader).collect())
    assert got == [("bad.pdf", 0, None, "damaged"), ("good.pdf", 1, "one", None), ("good.pdf", 2, "two", None)]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": "a", "ids": ["x"]},\n {"id": "b"}]')
    (tmp_path / "map.json").write_text('{"(2007) 3 SCC 755": "A",\n "k": "B"}')
    assert tables.json_rows(spark, str(tmp_path / "list.json"), "id string, ids array<string>").count() == 2
    assert {r["citation"]: r["case_id"] for r in tables.json_map(spark, str(tmp_path / "map.json"), "citation", "case_id").collect()} == {"(2007) 3 SCC 755": "A", "k": "B"}
    rows = spark.createDataFrame([("c1", 'says "x",\nthen y')], "case_id string, explanation_text string")
    template = tables.rating_template(rows)
    assert template.columns == tables.RATING_COLUMNS
    tables.write_csv(template, str(tmp_path / "ratings"))
    back = tables.read_ratings(spark, str(tmp_path / "ratings")).collect()
    assert len(back) == 1 and back[0]["explanation_text"] == 'says "x",\nthen y' and not back[0]["clarity_1_to_5"]


def test_index_upserts(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "chunk_id string, v string")
    tables.add_to_index(spark, path, rows("a", "b", "b"))
    tables.add_to_index(spark, path, rows("b", "c"))
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    new = spark.createDataFrame([("b", "new")], "chunk_id string, v string")
    assert {r["chunk_id"]: r["v"] for r in tables.upserted(spark.read.parquet(path), new, "chunk_id").collect()}["b"] == "new"
    flat = tables.sanitised(spark.createDataFrame([(["x", "y"], None, 1)], "a array<string>, s string, n int"), ["a", "s", "n"]).first()
    assert tuple(flat) == ("x, y", "", 1)
    assert spark.range(1).select(tables.storage_key(F.lit("a/b\\c d"))).first()[0] == "a_b_c_d"


def test_latex(spark):
    rows = spark.createDataFrame([("x", None), ("first_only", 0.5)], "mode string, mrr double")
    out = tables.latex_table(rows, ["mode", "mrr"], "Means", "mode").first()["latex"]
    assert "first\\_only & 0.5000 \\\\\nx & -- \\\\\n" in out and out.endswith(r"\end{table}")


def test_following_a_folder(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "chunk_id string, v string")
    source, index, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    rows("a", "b").write.parquet(source)
    incremental.follow(spark, source, "chunk_id string, v string", index, check).awaitTermination()
    rows("b", "c").write.mode("append").parquet(source)
    incremental.follow(spark, source, "chunk_id string, v string", index, check).awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.read.parquet(index).collect()) == ["a", "b", "c"]


def test_windows_of_a_stream_and_of_a_table_agree(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    data = [(1, at(0, 5), "a", 1.0), (1, at(0, 20), "a", 2.0), (2, at(0, 59), "b", 3.0), (1, at(3, 0), "a", 4.0), (2, at(9, 0), "b", 1.0)]
    events = spark.createDataFrame(data, "user_id int, ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    table = sorted(map(tuple, incremental.window_counts(events).collect()))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = incremental.window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == table
    found = sorted((r["user_id"], r["n"]) for r in incremental.sessions(events).collect())
    assert found == [(1, 1), (1, 2), (2, 1), (2, 1)]
