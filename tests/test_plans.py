"""Plans are those that scale: no nested loops over tables, columns and filters pushed into scans, no Python where an expression does."""

import pytest

from quillmask import catalog

D = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j05_canaries", "j01_assign_tokens", "j02_resolve_tokens", "x06_validate_actions", "x11_score_sites", "j07_j09_match", "w01_number_values"])
def test_joins_are_by_equality(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["d18_detect_patterns", "x02_merge_spans", "x04_leak_gate", "x07_plan_next", "f30_render_screen", "a16_masked_share", "l03_label_ranking", "f25_entity_spans"])
def test_expressions_stay_in_the_engine(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_detection_does_not_shuffle(spark):
    assert "Exchange" not in plan(spark, "d01_email_in_documents")


def test_scans_read_what_is_used(spark):
    assert "LessThan(vec_id,5)" in plan(spark, "l03_label_ranking")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan(spark, "j20_once_per_text").replace("turn:int", "turn:bigint")
