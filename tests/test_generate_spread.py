"""Calls of a generator run in many tasks, however few partitions the leads come in."""

import pandas as pd
import pytest
from pyspark import TaskContext

from canvass.operators.generate import generate, upper_generator


def where_it_ran(prompts):
    return [f"{TaskContext.get().partitionId()} {p}" for p in prompts]


@pytest.mark.parametrize("journaled", [False, True])
def test_one_partition_of_leads_is_spread(spark, tmp_path, journaled):
    leads = spark.createDataFrame([(i, f"N{i}") for i in range(200)], "row_id bigint, company_name string").coalesce(1)
    out = generate(leads, where_it_ran, "{company_name}", "-", journal=str(tmp_path / "j") if journaled else None).collect()
    assert sorted(r.generated_email.split()[1] for r in out) == sorted(f"N{i}" for i in range(200))
    assert len({r.generated_email.split()[0] for r in out}) >= 4


def test_upper_generator_keeps_its_answers():
    assert upper_generator(pd.Series(["aß", "b"])) == ["ASS", "B"]
    assert upper_generator(pd.Series([None, "b"], dtype=object)) == [None, "B"]
    with pytest.raises(ValueError, match="no company name"):
        upper_generator(pd.Series(["x", "Business name: N/A, y"]))
