import __spark_entry__ as entry


def test_flagship_has_rows_and_confidence(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.score <= r.confidence <= 1 for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shuffle_partitions_follow_the_tables(spark, monkeypatch):
    from lorewell.plans import registry

    key, data = "spark.sql.shuffle.partitions", "/root/testdata/sf0.001"
    before = spark.conf.get(key)
    monkeypatch.setattr(registry, "PARTITION_BYTES", 1000, raising=False)
    try:
        registry.table(spark, data, "lineitem")
        assert int(spark.conf.get(key)) > 100
        registry.table(spark, data, "region")
        assert int(spark.conf.get(key)) > 100
        spark.conf.set(registry.ADVISORY, "8m")
        registry.table(spark, data, "documents")
        assert spark.conf.get(registry.ADVISORY) == "8m"
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shuffled_rows_are_joined_up_to_a_fixed_size_in_a_session_of_many_partitions(spark):
    """Where the session's own number of partitions was enough, tasks were joined up to Spark's 64 MB and grew with the tables up to there."""
    from lorewell.plans import registry

    key = "spark.sql.shuffle.partitions"
    before, advice = spark.conf.get(key), spark.conf.get(registry.ADVISORY, None)
    try:
        spark.conf.set(key, "200")
        spark.conf.unset(registry.ADVISORY)
        registry.table(spark, "/root/testdata/sf0.001", "lineitem")
        assert (spark.conf.get(key), spark.conf.get(registry.ADVISORY)) == ("200", registry.ADVISED)
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(registry.ADVISORY) if advice is None else spark.conf.set(registry.ADVISORY, advice)


def test_files_are_read_in_pieces_of_a_fixed_size(spark):
    """A task's share of a scan grew with the table up to Spark's 128 MB."""
    from lorewell.plans import registry

    before = spark.conf.get(registry.SPLIT, None)
    try:
        spark.conf.unset(registry.SPLIT)
        registry.table(spark, "/root/testdata/sf0.001", "lineitem")
        assert spark.conf.get(registry.SPLIT) == registry.ADVISED
        spark.conf.set(registry.SPLIT, "3m")
        registry.table(spark, "/root/testdata/sf0.001", "lineitem")
        assert spark.conf.get(registry.SPLIT) == "3m"
    finally:
        spark.conf.unset(registry.SPLIT) if before is None else spark.conf.set(registry.SPLIT, before)
