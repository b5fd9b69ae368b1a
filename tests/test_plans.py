"""Plan guards: the physical plans keep the properties the design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from evalloop.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

# Queries whose construction starts jobs with side effects (streams, model rounds, loop writes).
SIDE_EFFECTS = {"incremental_judge", "running_stats", "attribution_job", "generation_job", "cot_job",
                "loop_two_rounds"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SIDE_EFFECTS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pass_at_k_is_hash_aggregated(spark):
    text = plan_text(E.queries()["pass_at_k"](spark, SF_SMALL))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_extraction_reads_only_needed_columns(spark):
    text = plan_text(E.queries()["head_limit"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in text
    assert "TakeOrderedAndProject" in text  # a top-k plan, not a full sort


def test_selected_queries_read_no_text(spark):
    """Queries without a text in their result do not read it."""
    for name in ("dataset_select", "sample_per_dataset", "provenance", "dataset_counts", "pick_one"):
        text = plan_text(E.queries()[name](spark, SF_SMALL))
        assert "text:string" not in text, name
