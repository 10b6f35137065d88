"""Model and stage on all texts, copies and unlabelled rows included."""

from pyspark.sql import functions as F


def test_kinds_of_text_are_found_beside_many_copies(spark):
    from gradeloom.llm import lm

    # the copied text has the least hash of all, so a sample by hash would hold nothing else
    names = spark.range(400).select(F.concat(F.lit("the same words again and again, number "), "id").alias("text"))
    copied = names.orderBy(F.xxhash64("text")).first().text
    kinds = ["съешь ещё этих мягких булок %d", "0123456789 31415926 2718281 %d", "zzqx jjkv qqwx xxyz vvkq %d"]
    rare = [k % i for k in kinds for i in range(12)]
    least = spark.createDataFrame([(copied,)], "text string").select(F.xxhash64("text")).first()[0]
    rare = [r[0] for r in spark.createDataFrame([(t,) for t in rare], "text string").where(F.xxhash64("text") > least).collect()]
    df = spark.createDataFrame([(t,) for t in [copied] * 3000 + rare], "text string")
    centres = lm.kinds_of(df.repartition(3), "text")
    told = [{lm._kind(t, centres) for t in rare if t[:4] == k[:4]} for k in kinds] + [{lm._kind(copied, centres)}]
    assert all(told) and all(not (a & b) for i, a in enumerate(told) for b in told[:i])


def test_language_stage_without_labels_keeps_texts(spark, sf):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "plain words", None, "s", 11), (2, "123 ...", None, "s", 7), (3, None, None, "s", 0)], kind)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()] == [1]
