from pathlib import Path

from blobtide.plans import charts, fees, rollups
from blobtide.plans.dashboard import dashboard, refresh
from blobtide.scratch import materialize, scratch_root
from blobtide.sources.inputs import Inputs
from verification.catalog import Tables


def test_dashboard_equals_the_single_functions(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    names = ["arbitrum", "base", "linea"]
    inputs = Inputs(t.mempool, t.sidecar, t.raw.txs, t.raw.sequencers)
    frames = dashboard(inputs, names)
    filtered = materialize(fees.filter_by_sequencer(t.joined, names))
    macro = rollups.rollup_macro(filtered)
    expected = {
        "inclusion_line": charts.inclusion_line_data(filtered, names),
        "inclusion_table": charts.inclusion_table(filtered, names),
        "rollup_summary": rollups.rollup_summary(macro),
    }
    for name, frame in expected.items():
        rows = sorted(map(str, frame.collect()))
        assert rows and rows == sorted(map(str, frames[name].collect())), name
    assert frames["rollup_macro"].count() == 3
    assert frames["fee_gwei"].count() == 2 * filtered.count()
    assert all(frame.columns for frame in frames.values())


def test_refresh_writes_every_table_and_leaves_no_scratch(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    names = ["arbitrum", "base", "linea"]
    inputs = Inputs(t.mempool, t.sidecar, t.raw.txs, t.raw.sequencers)
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.glob("*"))
    written = refresh(inputs, names, str(tmp_path))
    assert set(written) == {p.name for p in tmp_path.iterdir()} and len(written) == 12
    assert set(root.glob("*")) == before
    rows = sorted(map(str, spark.read.parquet(str(tmp_path / "rollup_macro")).collect()))
    assert len(rows) == 3
    # a second refresh replaces the first
    assert refresh(inputs, names, str(tmp_path)) == written
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "rollup_macro")).collect())) == rows
