"""Every registered query next to its SQL, and what its plan may not contain."""
import pytest

import __spark_entry__ as contract
from enrichflow.queries import CATALOG
from tests import oracle
from tests.conftest import plan_of

SF = "/root/testdata/sf0.001"
PYTHON = {"q_page_links", "q_link_resolve", "q_link_first", "q_records", "q_quarantine", "q_empty_pages", "q_unique_records",
          "q_discovery_counts", "q_warning_list", "q_warning_summary", "q_private_endpoint", "q_enrich", "q_xml",
          "q_enrich_waves", "q_day_pages", "q_listing", "q_listing_rejects", "q_first_block"}


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, duck, name):
    assert oracle.compare(spark, duck, name, CATALOG[name], SF) is None


def test_contract(spark):
    assert set(CATALOG) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in CATALOG if not n.startswith(("q_stream", "q_persist", "q_report_files", "q_strict", "q_summary_files", "q_snapshot"))])
def test_plan(spark, name):
    plan = plan_of(CATALOG[name].run(spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan
    if name == "q_select_topn":
        assert "TakeOrderedAndProject" in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(CATALOG["q_run_counts"].run(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan and "html" not in plan
