import corpus_pipeline
from lineloom.llm import exact_dedup, mixing, simhash, toxicity
from tests.llm import cases
from tests.llm.test_classifiers import corpus


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs, labels = corpus(300)
    docs += [(10_000 + i, docs[i][1].upper(), "en", "other", 0) for i in range(0, 60, 3)]
    path = cases.table(spark, tmp_path, cases.frame(spark, docs, extra=True))
    cases.table(spark, tmp_path, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "labels")
    df = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, path)
        if name != "sentencepiece":
            assert df.columns == before.columns
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = df.count()
    source = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{path}/labels.parquet"))
    assert kept["toxicity"] == toxicity.score_rows(source, model).where("predicted = 0").count()
    assert kept["exact_dedup"] == exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/toxicity")).where("kept").count() < kept["toxicity"]
    assert kept["simhash_near_dedup"] == simhash.near_dedup(spark.read.parquet(f"{tmp_path}/exact_dedup")).select("component_id").distinct().count()
    assert kept["mixing"] == mixing.mix_rows(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).agg({"copies": "sum"}).first()[0]
    assert kept["sentencepiece"] == kept["mixing"]
    rows = corpus_pipeline.run(spark, path)
    assert rows.count() == kept["sentencepiece"] and rows.where("not exact").count() == 0
