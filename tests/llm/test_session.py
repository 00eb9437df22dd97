"""Operators of this subpackage leave the session fit for models of the core."""
import __spark_entry__ as ent
from tests.conftest import SF_TINY


def test_models_run_after_line_dedup(spark):
    qs = ent.queries()
    assert qs["op7_line_dedup"](spark, SF_TINY).count() > 0
    for name in ("k4_forest_staging", "e1_evaluate_model"):
        assert qs[name](spark, SF_TINY).count() > 0
