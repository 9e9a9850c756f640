from pyspark.sql import functions as F

from groundmill.operators import claims, prompts, retrieval
from groundmill.streaming import arrivals


def drain(stream, mode, name, folder):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def source(spark, sf, tmp_path, parts=4):
    table = spark.read.parquet(f"{sf}/raw_examples.parquet")
    folder = str(tmp_path / "in")
    table.repartition(parts, "rec_id").write.parquet(folder)
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counts_of_a_stream_equal_those_of_the_table(spark, sf, tmp_path):
    table, stream = source(spark, sf, tmp_path)
    args = ("dataset_id", "created_at", "fetched_at", "2000 days")
    got = drain(arrivals.arrivals_by_day(stream, *args), "complete", "by_day", str(tmp_path / "c1"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in arrivals.arrivals_by_day(table, *args).collect()}


def test_examples_of_a_stream_come_once(spark, sf, tmp_path):
    table, stream = source(spark, sf, tmp_path)
    args = ("rec_id", "dataset_id", "split", "payload", "fetched_at", "2000 days")
    got = drain(arrivals.unified(stream, *args).select("dataset_id", "query"), "append", "unified", str(tmp_path / "c2"))
    want = arrivals.unified(table, *args).select("dataset_id", "query")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 10


def test_models_plug_in(spark):
    rows = spark.createDataFrame([(1, "q", [("t1",), (None,), None]), (2, None, None)], "id int, question string, contexts array<struct<text: string>>")
    asked = rows.select("id", prompts.prompt(F.col("question"), F.col("contexts"), "base").alias("prompt"))
    echo = lambda: lambda ps: [p + " " + str(len(p)) for p in ps]
    got = {r.id: r.answer for r in prompts.generate(asked, "id", "prompt", echo, "echo", "base").collect()}
    assert got == {str(r.id): str(len(r.prompt)) for r in asked.collect()}
    judge = lambda: lambda premises, cs: [(1.0, 2.0, 0.0) if "t1" in p else (0.0, 0.0, 1.0) for p in premises]
    scored = claims.softmax_label(prompts.score(asked.withColumn("claim", F.lit("c")), ["id"], "claim", "prompt", judge))
    assert {r.id: r.label for r in scored.collect()} == {1: "conflict", 2: "irrelevant"}


def test_index_is_reused_or_rebuilt(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y"), ("b", "y z z")], "id string, text string")
    path = str(tmp_path / "index")
    first = retrieval.ensure_index(docs, "id", "text", path)
    files = set(first.postings.inputFiles())
    assert set(retrieval.ensure_index(docs, "id", "text", path).postings.inputFiles()) == files
    grown = docs.unionByName(spark.createDataFrame([("c", "w")], docs.schema))
    assert retrieval.ensure_index(grown, "id", "text", path).stats.first().docs == 3
