from tidemark.llm import packing, secrets


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    docs, sizes = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == source.columns and docs.dtypes == source.dtypes
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    assert secrets.digest(secrets.scan(docs)).agg({"n_assign": "sum"}).first()[0] == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.agg({"n_words": "sum"}).first()[0] == packing.items(docs).agg({"n_words": "sum"}).first()[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = spark.read.parquet(str(tmp_path / "quality_classifier")).join(labels, "doc_id")
    assert kept.where("quality = 1").count() == source.join(labels, "doc_id").where("quality = 1").count()


def test_classifier_and_language_on_held_out_rows(spark):
    from tidemark.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op1_quality_classifier(spark, sf_dir).join(labels, "doc_id").where("held_out")
    right, n = rows.selectExpr("sum(cast(predicted = quality as int))", "count(*)").first()
    assert right / n >= 0.95
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out")
    right, n = rows.selectExpr("sum(cast(lang_pred = lang as int))", "count(*)").first()
    assert right / n >= 0.98


def test_oracles_on_the_smallest_tables(spark):
    import duckdb

    from tidemark.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, text in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.sql(text)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
        assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(rows, key=str), name


def test_pipeline_on_empty_tables_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    empty = str(tmp_path / "empty")
    for name, table in (("documents", source), ("labels", labels), ("benchmark", benchmark)):
        table.where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    odd = str(tmp_path / "odd")
    item = benchmark.where("length(text) > 60").orderBy("item_id").first().text
    clean = source.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").limit(1).select(*source.columns)
    text = clean.first().text
    extra = spark.createDataFrame([(None, text, "en", "s", None), (None, item + " " + text, "en", "s", None), (None, None, None, None, None), (7, "", "en", "s", 0)], source.schema)
    source.unionByName(clean).unionByName(extra).write.parquet(f"{odd}/documents.parquet")
    labels.write.parquet(f"{odd}/labels.parquet")
    benchmark.write.parquet(f"{odd}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, odd)
    ids = packed.groupBy("doc_id").agg({"n_words": "sum"}).collect()
    assert sum(r.doc_id == clean.first().doc_id for r in ids) <= 1 and not any(r.doc_id is None for r in ids)


def test_pipeline_stages_with_clashing_and_dotted_columns(spark, tmp_path):
    """Every stage keeps columns that have the names the operators use inside, and drops and keeps the same rows as without them."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf_dir = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    repeated = plain.where("doc_id < 5").withColumn("text", F.concat("text", F.lit(" and more")))
    plain = plain.unionByName(repeated)  # ids that repeat take the longer way through the near-duplicates
    names = ["__t", "__c", "__m", "__k0", "__h1", "__h2", "__node", "__own", "__given", "a.b", "score", "row", "node", "comp", "t", "k0", "found", "n"]
    docs = plain.select("*", *[F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(names)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = stage(spark, plain, sf_dir), stage(spark, docs, sf_dir)
        assert docs.columns == columns
        for table, kind in ((plain, "plain"), (docs, "clash")):
            table.write.parquet(str(tmp_path / f"{name}-{kind}"))
        plain, docs = (spark.read.parquet(str(tmp_path / f"{name}-{kind}")) for kind in ("plain", "clash"))
        same = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text").collect())
        assert same(docs) == same(plain) and len(same(docs)) > 0
        for i, c in enumerate(names):
            assert docs.where(F.col(f"`{c}`") != F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string"))).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
