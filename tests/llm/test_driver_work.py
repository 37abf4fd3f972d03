"""The driver's memory grows with the jobs it plans, so their number is bounded."""

from millrace.llm.kneser_ney import count_grams, fit
from millrace.scratch import settle


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_the_model_of_all_orders_takes_few_jobs(spark):
    texts = [(i, "en" if i % 2 else "de", " ".join(f"w{i * 31 + k * k}x" for k in range(30))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    counts = settle(count_grams(docs), "test-counts")
    model, jobs = jobs_of(spark, "kn-fit", lambda: fit(counts))
    assert {r.lang for r in model.select("lang").distinct().collect()} == {"de", "en"}
    assert model.groupBy("lang", "gram").count().where("count > 1").isEmpty()
    assert jobs <= 45
