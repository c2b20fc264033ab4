import pytest
from pyspark.sql import functions as F

from calltriage.operators import signatures
from calltriage.plans import registry

from .conftest import SF


def filters(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x.split("(")[0]]


@pytest.mark.parametrize("name", ["misses_except", "sig_snippets", "first_snippet", "sig_prevalence", "sig_hits_long"])
def test_no_filter_repeats_the_rules(spark, name):
    """A filter on what the rules found, moved below them, would match them for each of its uses."""
    found = filters(registry.queries()[name](spark, SF))
    assert found and not any("RLIKE" in x for x in found)


@pytest.mark.parametrize("name", ["sig_hits_long", "sig_prevalence"])
def test_each_pattern_is_tried_once(spark, name):
    """the work on a text doesn't grow with what is done with its hits."""
    hits, n = registry.queries()[name](spark, SF), sum(len(r.patterns) for r in signatures.RULES)
    uses = [hits, hits.groupBy().count(), hits.filter("severity = 3"), hits.orderBy(*hits.columns), hits.agg(*[F.max(c) for c in hits.columns])]
    assert [u._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(") for u in uses] == [n] * len(uses)
