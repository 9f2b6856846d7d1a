"""Documents written in parts: frames, order, versions, failures; places from a large table."""

import json

import pytest
from pyspark.sql import functions as F

from agendula.operators import gazetteer
from agendula.sources import documents


def _events(spark, n):
    return spark.range(n).select(F.col("id").alias("start"), F.concat(F.lit("Événement "), F.col("id").cast("string")).alias("title"), F.when(F.col("id") % 2 == 0, "x").alias("note")).repartition(7)


def test_a_feed_in_parts(spark, tmp_path):
    folder = str(tmp_path)
    documents.feed(_events(spark, 1000), folder, ["start"], part_lines=64)
    files, _ = documents.index(folder)
    assert len(files["events.json"]) == 16
    got = json.loads(b"".join(documents.stream(folder, "events.json", '{"generated":"2026-07-15","events":[', "]}")))
    assert [e["start"] for e in got["events"]] == list(range(1000)) and got["events"][3] == {"start": 3, "title": "Événement 3"}


def test_a_failed_write_leaves_the_last_feed(spark, tmp_path):
    folder = str(tmp_path)
    documents.feed(_events(spark, 10), folder, ["start"])
    before = list(documents.stream(folder, "events.json"))
    with pytest.raises(Exception):  # noqa: B017
        lines = _events(spark, 500).select(F.lit("events.json").alias("path"), F.col("start").alias("part"), F.when(F.col("start") < 400, F.col("title")).otherwise(F.raise_error(F.lit("stopped"))).alias("line"))
        spark.dataSource.register(documents.Documents)
        lines.write.format("documents").mode("append").save(folder)
    assert list(documents.stream(folder, "events.json")) == before
    documents.feed(_events(spark, 3), folder, ["start"])
    assert b"".join(documents.stream(folder, "events.json")).count(b"title") == 3


def test_pages_are_whole_files(spark, tmp_path):
    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, "Nice").otherwise(F.concat(F.lit("T"), (F.col("id") % 5).cast("string"))).alias("key"), F.lit("town").alias("kind"), F.col("id").alias("position"))
    documents.pages(rows, f"{tmp_path}/parts", F.concat(F.lit("<li>"), F.col("position").cast("string"), F.lit("</li>")), part_lines=50)
    assert documents.export(spark, f"{tmp_path}/parts", f"{tmp_path}/site", "<ul>\n", "\n</ul>") == 6
    page = (tmp_path / "site/town/Nice.html").read_text().split("\n")
    assert page == ["<ul>", *[f"<li>{i}</li>" for i in range(300) if i % 3], "</ul>"]
    assert sorted(p.name for p in (tmp_path / "site/town").iterdir()) == ["Nice.html", *[f"T{i}.html" for i in range(5)]]


def test_no_documents(spark, tmp_path):
    documents.feed(_events(spark, 0), str(tmp_path), ["start"])
    assert documents.index(str(tmp_path))[0] == {} and documents.export(spark, str(tmp_path), f"{tmp_path}/site") == 0


def test_places(spark):
    names = spark.createDataFrame([("Nice", "Nice"), ("Saint-Martin", "Saint-Martin"), ("Saint-Martin-Vésubie", "Saint-Martin-Vésubie"), ("ST JEAN", "Saint-Jean"), ("Èze", "Èze"), ("Eze", "Eze (village)"), ("", "none")], "name string, place string")
    texts = ["12ter Place Garibaldi 06 NICE", "Saint Martin Vesubie, près de Nice", "à saint-martin et à Nice", "Venice Beach", "", None, "eze", "St. Jean!"]
    got = {r.id: r.place for r in gazetteer.named_places(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), names).collect()}
    assert [got[i] for i in range(8)] == ["Nice", "Saint-Martin-Vésubie", "Saint-Martin", None, None, None, "Eze (village)", "Saint-Jean"]


def test_a_table_of_many_places(spark):
    names = spark.range(35_000).select(F.concat(F.lit("Commune "), F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, " sur mer").otherwise("")).alias("name")).withColumn("place", F.col("name"))
    texts = spark.range(2_000).select("id", F.concat(F.lit("salle des fêtes, commune-"), (F.col("id") * 14).cast("string"), F.lit("-sur-mer")).alias("text"))
    out = gazetteer.named_places(texts, names)
    assert out.where("place = concat('Commune ', cast(id * 14 as string), ' sur mer')").count() == 2_000
    assert gazetteer.named_places(texts, names.limit(0)).where("place is not null").count() == 0
