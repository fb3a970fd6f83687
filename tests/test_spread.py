"""Queries that take long for a row deal their rows over tasks, whatever the files' row groups; batches stay small."""

import pytest

from scorewright.plans import registry
from scorewright.plans.views import spread

HEAVY = ["choice_by_scheme", "tree_edit_by_language", "cer_corpus", "ned_anls_by_category", "bleu_corpus", "jaccard_uni_bi", "token_f1_by_category", "if_loose_prompt", "if_all_checks", "task_hike_test", "task_fleurs_en2ko_test", "task_librispeech_test_clean"]


@pytest.mark.parametrize("name", HEAVY)
def test_heavy_rows_are_dealt_evenly(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_spread_keeps_all_rows(spark):
    rows = spread(spark.range(1000).coalesce(1), "id")
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() >= 16


@pytest.mark.parametrize("name", ["soft_repetition", "trailing_repetition"])
def test_batches_of_whole_texts_are_bounded(spark, sf, name):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 10_000)
        registry.queries()[name](spark, sf)
        assert int(spark.conf.get(setting)) <= 1000
    finally:
        spark.conf.set(setting, before)
