"""Panel queries that cover their whole id."""
from panelwright.plans import registry
from panelwright.sources.fixture import bars

SF = "/root/testdata/sf0.001"


def test_all_instruments_are_pivoted(spark):
    got = registry.QUERIES["b11_long_to_wide_all"](spark, SF)
    assert got.columns == ["session", *(f"i{i}" for i in range(20))]
    n = got.selectExpr(*(f"count(i{i}) n{i}" for i in range(20))).first()
    there = {x.inst for x in bars(spark, SF).filter("close is not null").select("inst").distinct().collect()}
    assert {i for i in range(20) if n[i]} == there and there - {0, 1, 2}


def test_keys_of_one_release_are_counted(spark):
    got = registry.QUERIES["c12_overlap_full_diff"](spark, SF).first()
    assert got.old_only > 0 and got.new_only > 0 and got.differing > 0 and got.keys == got.pairs + got.old_only + got.new_only


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
