"""Edge cases of the operators on small hand-made rows."""

from pyspark.sql import functions as F

from larkspur.functions import geo, text, weekly
from larkspur.operators import apportion, search, sync
from larkspur.streaming import events as ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows(spark):
    rows = spark.createDataFrame([(1, 6, 1320, 1560), (2, 6, 600, 660), (3, 7, 0, 1440)], "deal_id int, day int, start int, end int")
    deals = rows.select("deal_id").distinct()
    ids = lambda df: sorted(r[0] for r in df.select("deal_id").collect())
    assert ids(search.active_now(deals, rows, 7, 60)) == [1, 3]
    assert ids(search.active_now(deals, rows, 6, 1200)) == []
    assert ids(search.in_time(deals, rows, 660, 700)) == [3]
    assert ids(search.in_time(deals, rows, 700, 600)) == [1, 2, 3]
    assert ids(search.in_time(deals, rows, 600, 600, [6])) == [2]


def test_hours(spark):
    f = lambda a, b: one(spark, weekly.covered_hours(F.lit(a), F.lit(b)))
    assert f(1200, 1380) == [20, 21, 22]
    assert f(1350, 1410) == [23]
    assert f(0, 1440) == []
    assert f(1320, 1560) == [22, 23]


def test_geo(spark):
    assert one(spark, geo.great_circle_km(F.lit(10.0), F.lit(10.0), F.lit(10.0), F.lit(10.0))) < 1e-3
    assert one(spark, geo.great_circle_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert [one(spark, geo.snap_radius(F.lit(x))) for x in (0.1, 2.0, 2.1, 100.0, 100.1)] == [2, 2, 5, 100, None]
    assert [one(spark, geo.distance_label(F.lit(x))) for x in (0.45, 0.001, 9.99, 25.6)] == ["450 m", "1 m", "10.0 km", "26 km"]
    assert one(spark, geo.suburb_radius_km(F.lit(-1.0))) == 0.5
    assert one(spark, geo.suburb_radius_km(F.lit(1.0), F.lit(5.0))) == 5
    assert not geo.valid_bounds(1, 2, 3, 4) and geo.valid_bounds(2, 1, 4, 3)


def test_text(spark):
    assert one(spark, text.slugify(F.lit("  Café & Bar! "))) == "cafe-bar"
    assert one(spark, text.suburb_slug(F.lit("Area"), F.lit(" "))) == "area"
    urls = {"HTTPS://A.Example/x/?utm_source=q&b=1#f": "https://a.example/x?utm_source=q&b=1", "http://a.example/": "http://a.example/", "http://a.example": "http://a.example", "http://a.example/b/": "http://a.example/b"}
    assert [one(spark, text.normalise_url(F.lit(u))) for u in urls] == list(urls.values())
    assert one(spark, text.strip_tracking(F.lit("https://a.example/x?utm_source=q&b=1"))) == "https://a.example/x?b=1"
    assert one(spark, text.emails(F.lit("mailto:Me@Pub.example, x@2x.png a@o1.sentry.io b@wixpress.com me@pub.example"))) == ["me@pub.example"]
    assert one(spark, text.normalise_url(F.lit("mailto:a@b.c"))) is None
    assert one(spark, text.trigram_similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("word")))) == 1
    assert one(spark, text.trigram_similarity(text.trigrams(F.lit("")), text.trigrams(F.lit("")))) == 0


def test_percentages(spark):
    for counts in ([1, 1, 1], [0, 0], [40, 30, 20, 5, 3, 2]):
        df = spark.createDataFrame([(k, n) for k, n in enumerate(counts)], "k int, n long")
        got = [r["percent"] for r in apportion.largest_remainder(df, "n", F.col("k")).orderBy("k").collect()]
        assert sum(got) == (100 if sum(counts) else 0)
    assert [r["percent"] for r in apportion.largest_remainder(spark.createDataFrame([(k, 1) for k in range(3)], "k int, n long"), "n", F.col("k")).orderBy("k").collect()] == [34, 33, 33]


def test_radius_join_is_exact(spark):
    points = [(k, -60 + (k * 37 % 1200) / 10, 100 + (k * 91 % 700) / 10) for k in range(150)]
    a = spark.createDataFrame(points, "id int, lat double, lng double")
    b = a.toDF("other_id", "other_lat", "other_lng")
    near = lambda df: {(r["id"], r["other_id"]) for r in df.select("id", "other_id").collect()}
    km = geo.great_circle_km(F.col("lat"), F.col("lng"), F.col("other_lat"), F.col("other_lng"))
    assert near(search.radius_join(a, b, 300.0)) == near(a.join(b, km <= 300.0))


def test_upsert_twice_changes_nothing(spark):
    current = spark.createDataFrame([(1, "a", None, 5), (2, "b", "x", 6)], "id long, name string, code string, n int")
    new = spark.createDataFrame([("a", None, 7), ("c", None, 8), ("b", "y", None)], "name string, code string, n int")
    once = sync.upsert(current, new, ["name", "code"], "id", keep_if_null=("n",))
    rows = {(r["name"], r["code"]): (r["id"], r["n"]) for r in once.collect()}
    assert rows[("a", None)] == (1, 7) and rows[("b", "x")] == (2, 6) and len(rows) == 4
    again = sync.upsert(once, new, ["name", "code"], "id", keep_if_null=("n",))
    assert {(r["name"], r["code"]): (r["id"], r["n"]) for r in again.collect()} == rows


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    failed = []

    def broken(df, n):
        raise ValueError("no")

    q = ingest.fan_out(ingest.projected(stream), [broken, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))], str(tmp_path / "cp"), lambda n, e: failed.append(n))
    q.awaitTermination()
    assert failed and spark.read.parquet(str(tmp_path / "out")).count() == ingest.projected(batch).count()
