from groundmill import session


def test_written_tables_are_read_back_and_discarded(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "id int, l array<string>")
    table = session.written(df, "t")
    assert table.schema == df.schema and {r.id for r in table.collect()} == {1, 2}
    assert session.shared_dir(spark) == spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = table.inputFiles()[0].rpartition("/")[0]
    session.discard_written(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_only_small_inputs_in_few_files_are_spread(spark, sf, monkeypatch):
    one = spark.read.parquet(f"{sf}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(one).rdd.getNumPartitions() == cores and session.spread(one).count() == one.count()
    made = spark.range(10)
    assert session.spread(made) is made
    monkeypatch.setattr(session, "SMALL_A_CORE", 1)
    assert session.spread(one) is one
