import corpus_pipeline


def test_stages_begin_and_end_with_a_full_collection(spark):
    """Of the executor, which on a local master is this JVM: once before a stage prepares its rows, once before they are written."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    docs = spark.createDataFrame([(1, "some words", "h", 10)], "doc_id long, text string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, "")
        assert full() >= before + 2
