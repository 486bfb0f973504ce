"""Recall and precision on held-out documents of the test data: votes of a third of the documents are kept back."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from riskframe.llm import toxicity as T

SF = f"{oracle.DATA}/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "content_labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    flags = T.scores(docs, labels.where(~held), passages=False).select("doc_id", F.col("toxic").alias("flag"))
    last = labels.where(held & F.col("toxic").isin(0, 1)).groupBy("doc_id", "rater_no").agg(F.max_by("toxic", "labelled_at").alias("v"))
    sure = last.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("v").alias("k")).where("n >= 2 and (k = 0 or k = n)")
    r = sure.join(flags, "doc_id").agg(F.expr("count_if(k > 0 and flag)").alias("tp"), F.expr("count_if(k > 0 and not flag)").alias("fn"), F.expr("count_if(k = 0 and flag)").alias("fp")).first()
    print(f"held out: {r['tp']} found, {r['fn']} missed, {r['fp']} false")
    assert r["tp"] / (r["tp"] + r["fn"]) >= 0.9 and r["tp"] / (r["tp"] + r["fp"]) >= 0.85
