"""Grades and recall on labelled documents that the model has not seen."""

from pyspark.sql import functions as F

from cairn.llm import toxicity as tx


def test_held_out_labels_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y"))
    rows = tx.toxicity(docs, even).join(odd, "doc_id").collect()
    bad, clean = [r for r in rows if r.y == 1], [r for r in rows if r.y == 0]
    assert len(bad) == 231 and sum(r.toxic for r in bad) >= 214
    assert sum(r.toxic for r in clean) <= 4
    # how severe the held-out texts are, by models of all labels that have not seen them
    sample = tx._sample(docs, labels)
    folds = {k: tx._fitted(sample.where(F.col("fold") == k).select("text", "toxic", F.col("toxic").alias("grade")), 1) for k in (0, 1)}
    graded = tx.graded(sample, folds).dropDuplicates(["text"]).withColumnRenamed("grade", "given")
    held = docs.join(odd, "doc_id").join(graded, "text").select("doc_id", "given").join(tx.toxicity(docs, even), "doc_id")
    mean = {r.given: r.s for r in held.groupBy("given").agg(F.avg("severity").alias("s")).collect()}
    assert set(mean) == {0, 1, 2} and mean[0] < 0.1 < 0.7 < mean[1] < 1.3 < mean[2]


def test_more_toxic_passages_are_a_higher_grade(spark):
    plain, foul = "one two three four five six seven eight nine ten ", "vile rotten nasty filthy "
    rows = [(f"{plain * 40}{i}", 0, i % 2) for i in range(40)] + [((plain * 4 + foul) * (1 + i % 6) + plain * 3 * (i % 4) + str(i), 1, i % 2) for i in range(60)]
    sample = spark.createDataFrame(rows, "text string, toxic long, fold int")
    folds = {k: tx._fitted(sample.where(F.col("fold") == k).select("text", "toxic", F.col("toxic").alias("grade")), 1) for k in (0, 1)}
    assert {len(p) for p in tx.passages(plain * 9)} == {40, 10}
    got = tx.graded(sample, folds).collect()
    assert len(got) == 100 and all(r.grade == 0 for r in got if not r.toxic) and all(r.grade >= 1 for r in got if r.toxic)
    # without a model of the other fold a toxic text is of the first grade
    assert {r.grade for r in tx.graded(sample, {0: None, 1: None}).collect()} == {0, 1}
