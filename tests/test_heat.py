"""Heat: hand cases and the published chart values."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.operators import heat
from heatloom.streaming.heat import stream_window_tops
from heatloom.streaming.trend import write_available

# Published measures of 13 topics, timeliness without its sign, the last but one
# the weighted intensity.
PUBLISHED = {
    "support": [0.200484066, 0.046389673, 0.095199677, 0.078862445, 0.04719645, 0.046994756, 0.08914885,
                0.257966922, 0.062121823, 0.075635337, 0.10104881, 0.056474385, 0.091165793],
    "attention": [0.143687082, 0.117106834, 0.140705253, 0.142958055, 0.130887365, 0.123560199, 0.149603788,
                  0.170986025, 0.156621, 0.125801894, 0.149195021, 0.142627902, 0.146930294],
    "timeliness": [0.185917973, 0.179816102, 0.180505637, 0.189002689, 0.185649557, 0.184477287, 0.187148772,
                   0.180975577, 0.191967893, 0.188974597, 0.197974247, 0.197075241, 0.193654747],
    "burst": [0.047600207, 0.029703064, 0.031911036, 0.05089567, 0.026682618, 0.096957473, 0.04540091,
              0.091917289, 0.048208732, 0.085119336, 0.085597637, 0.068557243, 0.100664015],
    "purity": [0.14773673, 0.194999539, 0.192364705, 0.234415403, 0.238315778, 0.224166949, 0.213069769,
               0.135444951, 0.214268587, 0.190628982, 0.149795262, 0.205548148, 0.194053582],
    "published_heat": [0.085601444, 0.035555992, 0.057097926, 0.057276719, 0.042795073, 0.046383471, 0.060043105,
                       0.106226993, 0.053477232, 0.050211082, 0.052055463, 0.047726177, 0.062169636],
    "share": [0.147753297, 0.087350872, 0.125593348, 0.12496471, 0.140130237, 0.117723954, 0.101434926,
              0.143818588, 0.127823623, 0.114378427, 0.113751111, 0.080042182, 0.088114497],
    "published_total": [0.233354741, 0.122906865, 0.182691274, 0.182241429, 0.18292531, 0.164107425, 0.161478031,
                        0.250045581, 0.181300623, 0.164589509, 0.165806574, 0.127768359, 0.150284133],
}
INCONSISTENT = {8: 0.01, 11: 0.01}


def test_published_values(spark):
    rows = list(zip(range(1, 14), *PUBLISHED.values()))
    frame = spark.createDataFrame(rows, ["prediction", *PUBLISHED]).withColumn("timeliness", -F.col("timeliness"))
    frame = frame.withColumn("heat", heat.weighted_heat())
    intensity = frame.select("prediction", (F.col("share") * 10).alias("intensity"))
    for row in frame.collect():
        assert row["heat"] == pytest.approx(row["published_heat"], abs=INCONSISTENT.get(row["prediction"], 1e-6))
    given = frame.withColumn("heat", F.col("published_heat"))
    for row in heat.total_heat(given, intensity).collect():
        assert row["total_heat"] == pytest.approx(row["published_total"], abs=3e-7)


def score(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, prediction int, p double, replies int, age_s long")
    return {r["prediction"]: r for r in heat.topic_heat(docs, **options).collect()}


def test_hand_case(spark):
    rows = [(i, 0, 0.5 + i / 100, i, 60 * i) for i in range(20)] + [(100, 1, 0.7, 9, 99)]
    found = score(spark, rows)
    top = rows[5:20]  # the 15 highest probabilities
    p = [r[2] for r in top]
    mean = sum(p) / 15
    row = found[0]
    assert row["post_num"] == 20 and row["support"] == pytest.approx(20 / 21)
    assert row["attention"] == pytest.approx(sum(math.log10(r[3] + 1) for r in top) / 15 / math.log10(20 ** 10))
    assert row["timeliness"] == pytest.approx(-sum(math.log10(r[4] + 1) for r in top) / 15 / math.log10(6000.0 ** 10))
    assert row["burst"] == pytest.approx(sum((x - mean) ** 2 for x in p) / 15 * sum(p))
    assert row["purity"] == pytest.approx(-1 / sum(x * math.log2(x) for x in p))
    assert found[1]["burst"] == 0


def test_corpus_size_and_certain_documents(spark):
    found = score(spark, [(1, 0, 1.0, 3, 10), (2, 0, 1.0, 5, 10)], corpus_size=4958)
    assert found[0]["support"] == pytest.approx(2 / 4958)
    assert found[0]["purity"] is None and found[0]["heat"] is None


def test_post_age(spark):
    posts = spark.createDataFrame([("2017-03-09,23:59",), ("2017-03-11,00:00",)], "time string")
    ages = [r["age_s"] for r in heat.post_age(posts, "2017-03-10 00:00:00").collect()]
    assert ages == [60, 0]


def test_heavy_cluster_is_cut_before_the_shuffle(spark, capsys):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("prediction"), F.rand(1).alias("p"))
    heat.cluster_docs(docs).explain()
    plan = capsys.readouterr().out
    shuffle = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]


POSTS = "doc_id long, prediction int, p double, replies int, time timestamp"


def dated_posts(spark, n=600):
    start = pd.Timestamp("2024-02-01", tz="UTC")
    rows = [(k, k * k % 4, 0.3 + k * 31 % 70 / 100, k * 7919 % 251, (start + pd.Timedelta(minutes=97 * (k * 37 % n))).to_pydatetime())
            for k in range(n)]
    return spark.createDataFrame(rows, POSTS)


def rounded(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_each_date_has_the_heat_of_its_slice(spark):
    posts = dated_posts(spark)
    intensity = spark.createDataFrame([(k, 1.0 + k) for k in range(4)], "prediction int, intensity double")
    found = heat.heat_by_window(heat.window_tops(posts, "3 days"), intensity).collect()
    starts = {r["window_start"] for r in found}
    assert len(starts) > 10
    for start in sorted(starts)[:3]:
        end = start + pd.Timedelta(days=3)
        part = posts.filter((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
        part = part.withColumn("age_s", F.unix_timestamp(F.lit(end)) - F.unix_timestamp("time"))
        want = heat.total_heat(heat.topic_heat(part), intensity)
        names = ["prediction", "post_num", "support", "heat", "total_heat"]
        assert rounded(want.select(*names).collect()) == rounded(
            tuple(r[n] for n in names) for r in found if r["window_start"] == start)


def test_tops_of_parts_merge(spark):
    posts = dated_posts(spark)
    whole = heat.heat_by_window(heat.window_tops(posts, "3 days"))
    halves = heat.window_tops(posts.filter("doc_id % 2 = 0"), "3 days").union(heat.window_tops(posts.filter("doc_id % 2 = 1"), "3 days"))
    assert rounded(whole.collect()) == rounded(heat.heat_by_window(halves).select(*whole.columns).collect())


def test_awkward_posts(spark):
    rows = [(1, 0, 0.5, 3, None), (None, None, 0.5, None, pd.Timestamp("2024-02-01").to_pydatetime()),
            (2, 0, None, 1, pd.Timestamp("2024-02-01").to_pydatetime()), (3, 0, 1.0, 1, pd.Timestamp("2024-02-01").to_pydatetime())]
    found = heat.window_tops(spark.createDataFrame(rows, POSTS), "3 days").collect()
    assert [(r["prediction"], r["post_num"]) for r in found] == [(0, 2)]
    assert heat.heat_by_window(heat.window_tops(spark.createDataFrame([], POSTS), "3 days")).collect() == []


def test_stream_gives_the_finished_dates(spark, tmp_path):
    """Five files in the order of time, a file per batch, so the state lives through batches."""
    posts = dated_posts(spark)
    ends = posts.selectExpr("percentile(unix_timestamp(time), array(0.2, 0.4, 0.6, 0.8, 1))").first()[0]
    low = 0
    for k, high in enumerate(ends):
        posts.filter((F.unix_timestamp("time") > low) & (F.unix_timestamp("time") <= high)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        low = high
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    tops = stream_window_tops(stream, "3 days", "1 day", parts=3)
    write_available(tops, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = heat.heat_by_window(spark.read.schema(tops.schema).parquet(f"{tmp_path}/out"))
    last = posts.agg(F.max("time")).first()[0]
    want = heat.heat_by_window(heat.window_tops(posts, "3 days")).withColumn("prediction", F.col("prediction").cast("long"))
    want = want.filter(F.col("window_start") + F.expr("interval 3 days") < F.lit(last - pd.Timedelta(days=1)))
    assert rounded(got.collect()) == rounded(want.select(*got.columns).collect()) and got.count() > 20
