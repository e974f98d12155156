"""Tables that survive their writers, scans by ranges, streams that go on."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from procmatch import catalog_queries, queries, source_queries
from procmatch.operators import lexical
from procmatch.plans import pipelines
from procmatch.sources import corpus, sinks
from procmatch.streaming import enrich


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string")


def test_a_dead_writer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    first = sinks.replace_table(rows(spark, 1, 2), path)
    for step in ("point", "before"):
        with monkeypatch.context() as m:
            if step == "point":  # the version is written, the pointer isn't moved
                m.setattr(sinks.Folder, "point", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt))
            else:  # writing the version fails in a task
                m.setattr(sinks, "upsert", lambda new, old, key: new.withColumn("title", F.raise_error(F.lit("killed"))))
            with pytest.raises((KeyboardInterrupt, Exception)):
                sinks.seed(rows(spark, 3), path)
        assert sinks.read_table(spark, path).count() == 2 and sinks.Folder(spark, path).current() == first
    assert sinks.seed(rows(spark, 2, 3), path)["total"] == 3


def test_versions_are_kept_for_readers_and_then_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = sinks.replace_table(rows(spark, 1), path)
    reader = sinks.read_table(spark, path)
    b = sinks.replace_table(rows(spark, 1, 2), path, expected=a)
    assert reader.count() == 1 and sinks.read_table(spark, path, a).count() == 1
    with pytest.raises(sinks.Moved):
        sinks.replace_table(rows(spark, 9), path, expected=a)
    assert sinks.read_table(spark, path).count() == 2
    sinks.replace_table(rows(spark, 1, 2, 3), path)
    kept = sinks.Folder(spark, path).versions()
    assert len(kept) == 2 and a not in kept and b in kept
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, f"file://{tmp_path}/none")


def test_places_without_a_global_window(spark):
    df = spark.createDataFrame([(f"k{i % 97:02d}", i) for i in range(500)] + [(None, 1)], "id string, _start long").repartition(7)
    got = corpus.numbered(df, "id", "_start").orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(1, 502))
    keys = [(r["id"] is not None, r["id"] or "", r["_start"]) for r in got]
    assert keys == sorted(keys)
    assert corpus.numbered(df.limit(0), "id").count() == 0


def test_database_scan_has_several_partitions(spark):
    at = source_queries.derby()
    spark.range(100).selectExpr("cast(id as string) as id", "'IS 1' as is_number", "'t' as title", "'Active' as status", "id as part_no").coalesce(1).write.format("jdbc").options(dbtable="things", **at).save()
    scan = spark.read.format("jdbc").options(dbtable="things", partitionColumn="part_no", lowerBound=0, upperBound=100, numPartitions=4, **at).load()
    assert scan.rdd.getNumPartitions() == 4
    got = corpus.table_scan(spark, "things", partition_on="part_no", partitions=4, **at)
    assert got.count() == 100 and got.agg(F.max("ord")).first()[0] == 100


def test_file_contents_are_read_only_of_admitted_files(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.PDF", b"other"), ("c.pdf", b"%PDF-" + b"x" * 100), ("d.txt", b"%PDF-")], "name string, content binary")
    corpus.write_files(files, f"file://{tmp_path}/f")
    got = corpus.read_files(spark, f"file://{tmp_path}/f", 50)
    assert {r["path"].rsplit("/", 1)[1]: (r["reject_reason"], r["content"] is not None) for r in got.collect()} == {"a.pdf": (None, True), "b.PDF": ("not_a_pdf", True), "c.pdf": ("too_large", False), "d.txt": ("unsupported_extension", False)}
    assert "LessThanOrEqual(length,50)" in got._jdf.queryExecution().executedPlan().toString()


def test_corpus_round_trip(spark, tmp_path):
    records = catalog_queries.full_records(spark, DATA)
    corpus.write_corpus(records, f"file://{tmp_path}/c", lines=7)
    back = corpus.read_corpus(spark, f"file://{tmp_path}/c", multi_line=False)
    columns = ["id", "is_number", "title", "keywords", "amendments", "related_standards", "description"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, records.select(columns).collect()))


def test_bucketed_index_stays_where_it_is(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["a", f"w{i % 9}", f"v{i % 5}"]) for i in range(60)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "w3"]), (2, ["v1"])], "query_id long, tokens array<string>")
    index = lexical.build_index(docs)
    index.save_buckets("bucket_test", 4, f"file://{tmp_path}/b")
    loaded = lexical.LexicalIndex.load_buckets(spark, "bucket_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lexical.score(loaded, asked, most=0)
        plan = got._jdf.queryExecution().optimizedPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
        pairs = {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs == {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in lexical.score(index, asked).collect()}
    scans = [x for x in plan[1].splitlines() if "FileScan" in x and "tf#" in x]
    assert scans and "Bucketed: true" in scans[0]
    above = plan[1].splitlines()[: plan[1].splitlines().index(scans[0])]
    assert not any("Exchange hashpartitioning(term" in x for x in above[-4:])


def test_request_stream_goes_on_after_a_stop(spark, tmp_path):
    """The second batch fails once; the restarted stream finishes it, and no batch is lost or doubled."""
    asked, catalog = queries.requests(spark, DATA), catalog_queries.full_catalog(spark, DATA, with_vectors=False)
    asked.repartition(4).write.parquet(f"file://{tmp_path}/in")
    columns = ["query_id", "rank", "doc_id", "relevance_score"]
    calls = []

    def once(df):
        calls.append(1)
        return df.select(columns).withColumn("rank", F.raise_error(F.lit("killed")).cast("int")) if len(calls) == 2 else df.select(columns)

    start = lambda: enrich.recommend_stream(enrich.arriving(spark, f"file://{tmp_path}/in", 1), catalog, f"file://{tmp_path}/out", f"file://{tmp_path}/state", 3, columns=once).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    got = sorted(map(str, enrich.ranked_so_far(spark, f"file://{tmp_path}/out").select(columns).collect()))
    want = sorted(map(str, pipelines.recommend(asked, catalog, 3).select(columns).collect()))
    assert got == want and len(calls) == 5


def test_rows_join_their_records_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "P-1"), (2, "P-9")], "query_id long, id string").write.parquet(f"file://{tmp_path}/in")
    records = spark.createDataFrame([("P-1", "title")], "id string, title string")
    stream = enrich.join_records(enrich.arriving(spark, f"file://{tmp_path}/in"), records, "id")
    stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {(r["query_id"], r["title"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {(1, "title"), (2, None)}
