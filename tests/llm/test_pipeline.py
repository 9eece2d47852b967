import corpus_pipeline


def test_stages_keep_clean_documents_and_act(spark):
    words = lambda tag, n: " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    clean = [(i, f"{words('qu' + chr(97 + i), 60)}\nshort end", "en", "s1", 9) for i in range(6)]
    base = words("near", 200).split()
    near = [(20 + k, " ".join([*base[: 50 + k], f"other{k}", *base[51 + k :]]), "en", "s2", 9) for k in range(3)]
    item = words("bench", 30)
    rows = [*clean, *near, (30, f"{item} tail", "en", "s2", 9), (31, "1234 !!", None, "s2", 9), (32, None, None, None, None), (33, clean[0][1], "en", "s2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept, data = {}, docs
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, data, folder).write.parquet(f"{folder}/{name}")
        data = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"] for r in data.collect()} if name != "mix" else {i for r in data.collect() for i in r["doc_ids"]}
        assert name == "mix" or data.columns == corpus_pipeline.COLUMNS
    everything = {r[0] for r in rows}
    assert kept["language"] == everything - {31, 32}
    lines = spark.read.parquet(f"{folder}/lines")
    assert kept["lines"] == kept["language"] - set() and lines.filter("doc_id = 33").first()["text"] == "short end"
    assert kept["near_copies"] == kept["lines"] - {21, 22}
    assert kept["benchmark"] == kept["near_copies"] - {30} == kept["mix"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_decisions_find_rows_with_null_and_repeated_ids(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    item, base, own = words("bench", 30), words("near", 200), words("own", 50)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = f"{base} more"
    rows = [(1, own), (1, item), (None, item), (None, near), (5, base), (5, own + " other words here"), (7, base), (7, base), (None, None), (8, "")]
    docs = spark.createDataFrame([(*r, "en", None, 0) for r in rows], SCHEMA).selectExpr("*", "'x' AS key1", "'x' AS id", "'x' AS row")
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert texts(stage("benchmark")(spark, docs, str(tmp_path))) == sorted((r for r in rows if r[1] != item), key=repr)
    gone = [(None, near), (7, base), (None, item), rows[5]]
    assert texts(stage("near_copies")(spark, docs, str(tmp_path))) == sorted((r for r in rows if r not in gone), key=repr)
    for name in ("language", "lines", "mix"):
        stage(name)(spark, docs, str(tmp_path)).collect()


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        df = f(spark, empty, str(tmp_path))
        assert df.count() == 0 and (name == "mix" or df.columns == corpus_pipeline.COLUMNS)


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["shard", "source", "slot", "block", "doc_ids", "text"]
    rows = found.collect()
    assert 150 < len({i for r in rows for i in r["doc_ids"]}) < 200 and all(1 <= len(r["text"].split(" ")) <= 64 for r in rows)
