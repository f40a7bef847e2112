from __future__ import annotations

import pytest

from cantiga.catalog import APPROVED_SOURCES, DEFAULT_SOURCE, SOURCES, VERSION, approved_source, check_keys
from cantiga.plans.catalogue import catalogue_table

ROYALTY_SOURCES = [name for name in SOURCES if name != "omie_detail"]


def test_default_and_approved_sources():
    assert VERSION == "v2"
    assert DEFAULT_SOURCE == "royalty_performance" == approved_source(None).name
    assert len(APPROVED_SOURCES) == 8


@pytest.mark.parametrize("name", ROYALTY_SOURCES)
def test_royalty_sources_have_royalties_and_no_ledger_keys(name):
    metrics = SOURCES[name].metrics
    assert "royalties" in metrics
    assert not {"revenue", "cost"} & set(metrics)


def test_ledger_has_no_royalties():
    assert list(SOURCES["omie_detail"].metrics) == ["revenue", "cost", "resultado", "payable"]


def test_dimensions_where_they_belong():
    assert "track" in SOURCES["orchard_detail"].dimensions
    assert "track" not in SOURCES["royalty_performance"].dimensions
    assert "gravadora" in SOURCES["royalty_performance"].dimensions
    assert "platform" in SOURCES["warner_chappell_detail"].dimensions


def test_unknown_source_is_refused():
    with pytest.raises(ValueError, match="not approved"):
        approved_source("does_not_exist")


def test_every_foreign_key_is_named():
    with pytest.raises(ValueError, match="cost, revenue"):
        check_keys(SOURCES["dsu_detail"], ["cost", "shows", "revenue"], ["artist"])
    with pytest.raises(ValueError, match="track"):
        check_keys(SOURCES["royalty_performance"], ["royalties"], ["track"])


def test_catalogue_table(spark):
    rows = catalogue_table(spark).collect()
    keys = sum(len(s.metrics) + len(s.dimensions) + 1 for s in SOURCES.values())
    assert len(rows) == keys
    assert {r.fonte for r in rows if r.padrao} == {"royalty_performance"}
