from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blobtide import schemas, scratch
from blobtide.plans import fees
from blobtide.sources import dimensions, files, inputs, scans

NOW = datetime(2024, 5, 8)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def mempool_file(spark, tmp_path):
    rows = [
        (NOW - timedelta(days=d), kind, 131072, 1000, f"0x{d}{kind}", "0xto", "0xS", ["h"], d, net, *[1.0] * 5)
        for d in (1, 6, 7, 9)
        for kind in (2, 3)
        for net in ("mainnet", "holesky")
    ]
    path = str(tmp_path / inputs.MEMPOOL_TABLE)
    files.write_cached(spark.createDataFrame(rows, schemas.MEMPOOL_TRANSACTION), path)
    return path


def test_scan_pushes_filters_and_columns_to_the_reader(spark, mempool_file):
    scan = scans.scan_mempool(files.read_cached(spark, mempool_file), NOW, 7, network="mainnet")
    # the bound itself is left out, as in "newer than"
    assert sorted(r.nonce for r in scan.collect()) == [1, 6]
    plan = plan_of(scan.select("hash", "nonce"))
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("EqualTo(type,3)", "GreaterThan(event_date_time", "EqualTo(meta_network_name,mainnet)"):
        assert part in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "blob_gas" not in schema and "blob_hashes" not in schema


def test_scan_without_as_of_uses_the_current_time(spark, mempool_file):
    assert scans.scan_mempool(files.read_cached(spark, mempool_file), n_days=7).count() == 0
    assert scans.scan_mempool(files.read_cached(spark, mempool_file), n_days=36500).count() == 8


def test_load_inputs(spark, mempool_file, tmp_path):
    slot = NOW - timedelta(days=2)
    sidecar = spark.createDataFrame(
        [(1, slot, slot, "r", "k", net, None, 0, "h", 1, 1) for net in ("mainnet", "holesky")],
        schemas.CANONICAL_SIDECAR,
    )
    txs = spark.createDataFrame(
        [(h, 1, None, 1.0, 1.0, 1.0, 1.0) for h in ("0x13", "0x12", "0x99")], schemas.TRANSACTIONS
    )
    files.write_cached(sidecar, str(tmp_path / inputs.SIDECAR_TABLE))
    files.write_cached(txs, str(tmp_path / inputs.TX_TABLE))
    loaded = inputs.load_inputs(spark, str(tmp_path), NOW)
    counts = {r.table_name: r.row_count for r in loaded.counts().collect()}
    assert counts == {"mempool": 2, "sidecar": 1, "txs": 1, "sequencers": 10}
    none = inputs.load_inputs(
        spark, str(tmp_path), NOW, producers=dimensions.ROLLUP_SEQUENCERS
    )
    assert none.mempool.count() == 0


def test_partitioned_parquet_keeps_schema_and_values(spark, tmp_path):
    df = spark.createDataFrame(
        [("007", 1, ["a"]), ("x", None, []), ("007", 3, None)],
        "part string, n int, items array<string>",
    )
    path = str(tmp_path / "t")
    files.write_cached(df, path, partition_by=["part"])
    back = files.read_cached(spark, path, df.schema)
    assert back.schema == df.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = files.read_cached(spark, path, df.schema, F.col("part") == "007")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(part" in plan_of(one)


def test_window_opens_only_its_days(spark, tmp_path):
    rows = [
        (NOW - timedelta(days=d, seconds=1), 3, 131072, 1000, f"0x{d}", "0xto", "0xS", ["h"], d, "mainnet", *[1.0] * 5)
        for d in (0, 3, 6, 7, 30)
    ]
    raw = spark.createDataFrame(rows, schemas.MEMPOOL_TRANSACTION)
    path = str(tmp_path / inputs.MEMPOOL_TABLE)
    files.write_days(raw, path)
    # a day outside the window that nobody could read
    for part in (tmp_path / inputs.MEMPOOL_TABLE / "event_date=2024-04-07").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    table = files.read_days(spark, path, schemas.MEMPOOL_TRANSACTION)
    assert table.columns == [*schemas.MEMPOOL_TRANSACTION.fieldNames(), "event_date"]
    scan = scans.scan_mempool(table, NOW, 7)
    assert sorted(r.nonce for r in scan.collect()) == [0, 3, 6]
    plan = plan_of(scan)
    assert "event_date" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "GreaterThan(event_date_time" in plan[plan.index("PushedFilters") :]
    # without as_of the bound is the current time, and the day is bounded all the same
    plan = plan_of(scans.scan_mempool(table, n_days=7))
    assert "event_date" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert scans.scan_mempool(table, n_days=7).count() == 0
    # a refresh replaces the days it has
    newer = raw.where("nonce = 3").withColumn("nonce", F.lit(33).cast("bigint"))
    files.write_days(newer, path, mode="overwrite")
    table = files.read_days(spark, path, schemas.MEMPOOL_TRANSACTION)
    assert sorted(r.nonce for r in scans.scan_mempool(table, NOW, 7).collect()) == [0, 6, 33]


def test_load_inputs_from_tables_laid_out_by_day(spark, tmp_path):
    slot = NOW - timedelta(days=2)
    mempool = spark.createDataFrame(
        [(slot, 3, 1, 1, "0xa", "0xto", "0xS", ["h"], 1, "mainnet", *[1.0] * 5)], schemas.MEMPOOL_TRANSACTION
    )
    sidecar = spark.createDataFrame(
        [(1, t, t, "r", "k", "mainnet", None, 0, "h", 1, 1) for t in (slot, slot - timedelta(days=9))],
        schemas.CANONICAL_SIDECAR,
    )
    txs = spark.createDataFrame([(h, 1, None, *[1.0] * 4) for h in ("0xa", "0xb")], schemas.TRANSACTIONS)
    files.write_days(mempool, str(tmp_path / inputs.MEMPOOL_TABLE))
    files.write_days(sidecar, str(tmp_path / inputs.SIDECAR_TABLE), moment="slot_start_date_time")
    files.write_cached(txs, str(tmp_path / inputs.TX_TABLE))
    loaded = inputs.load_inputs(spark, str(tmp_path), NOW)
    assert "event_date" not in loaded.mempool.columns + loaded.sidecar.columns
    assert {r.table_name: r.row_count for r in loaded.counts().collect()} == {
        "mempool": 1, "sidecar": 1, "txs": 1, "sequencers": 10,
    }
    assert loaded.txs.count() == 2
    for frame in (loaded.mempool, loaded.sidecar):
        plan = plan_of(frame)
        assert "event_date" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]


def block(slot, version, seen, root, network="mainnet"):
    return (slot, NOW, root, 10, 5, "teku", network, seen, version)


def test_latest_version_counts_before_the_window(spark):
    day, old = timedelta(days=1), NOW - timedelta(days=40)
    raw = spark.createDataFrame(
        [
            block(1, 1, NOW, "a"), block(1, 2, NOW, "b"),
            # the newest version was seen before the window
            block(2, 1, NOW, "c"), block(2, 9, old, "d"),
            # an older version was
            block(3, 1, old, "e"), block(3, 2, NOW, "f"),
            # no version in the window; another network
            block(4, 1, old, "g"), block(1, 99, NOW, "h", "holesky"),
            # equal versions, equal rows, no slot, no version
            block(5, 7, NOW, "x"), block(5, 7, NOW, "y"), block(6, 1, NOW, "z"), block(6, 1, NOW, "z"),
            block(None, 1, NOW, "n"), block(None, 2, NOW, "m"), block(7, None, NOW, "o"), block(7, 0, NOW, "p"),
            block(8, None, NOW, "q"),
        ],
        schemas.CANONICAL_BLOCK,
    )
    got = scans.scan_canonical_block(raw, NOW + day, 7).collect()
    assert sorted(((r.slot, r.block) for r in got), key=str) == sorted(
        [(1, "b"), (3, "f"), (5, "y"), (6, "z"), (None, "m"), (7, "p"), (8, "q")], key=str
    )


def test_latest_version_sorts_no_text(spark, monkeypatch):
    from blobtide.operators import rows

    plans, materialize = [], rows.materialize
    monkeypatch.setattr(rows, "materialize", lambda df, label: plans.append(plan_of(df)) or materialize(df, label))
    raw = spark.createDataFrame([block(i, i % 3, NOW, f"r{i}") for i in range(50)], schemas.CANONICAL_BLOCK)
    plans.append(plan_of(rows.latest_per_key(raw, ["slot"], "version")))
    assert len(plans) == 2 and not any("SortAggregate" in p for p in plans)
    assert "HashAggregate" in plans[0]


def test_one_csv_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [(i, f"line\n{i}\r\nback\\slash \\n \\s \\", "" if i % 3 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, text string, other string")
    path = str(tmp_path / "csv")
    files.export_csv(df.coalesce(1), path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    try:
        back = files.read_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, back.collect())) == rows
        assert files.read_csv(spark, path, df.schema, escaped=False).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set(key, before)


def test_csv_keeps_quotes_line_breaks_nulls_and_microseconds(spark, tmp_path):
    rows = [
        ('say "hi", ok', datetime(2024, 1, 1, 0, 0, 0, 123456), 1.5),
        ("two\nlines", datetime(2024, 1, 1), None),
        ("", None, -1.0),
        (None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double")
    path = str(tmp_path / "csv")
    files.export_csv(df, path)
    back = files.read_csv(spark, path, df.schema).collect()
    assert {r.v: (r.s, r.t) for r in back} == {v: (s, t) for s, t, v in rows}


def test_dimension_join_is_broadcast_only_while_small(spark):
    incl = spark.createDataFrame([("0xS",)], "`from` string")
    small = dimensions.sequencer_dim(spark)
    assert small.count() == 10
    assert "BroadcastHashJoin" in plan_of(fees.inclusion_with_rollup(incl, small))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")  # bytes, less than the dimension has
    try:
        plan = plan_of(fees.inclusion_with_rollup(incl, small))
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_scratch_lies_below_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_root(spark).startswith(root)
    stored = scratch.materialize(spark.range(10), "ten")
    assert stored.count() == 10 and root in plan_of(stored)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        applicationId = "app"
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())


def test_scopes_free_their_tables(spark):
    def exists(df):
        return bool(df.inputFiles()) and df.count() >= 0

    outside = scratch.materialize(spark.range(3), "outside")
    with scratch.scope(spark) as own:
        inner = scratch.materialize(spark.range(4), "inner")
        with scratch.scope(spark):
            scratch.materialize(spark.range(5), "innermost")
        kept = scratch.settled(
            spark, lambda: scratch.materialize(spark.range(6), "way").withColumn("x", F.col("id") + 1), "kept"
        )
        assert len(own.paths) == 2 and kept.count() == 6 and inner.count() == 4
        paths = list(own.paths)
    assert own.paths == [] and outside.count() == 3
    jvm = spark.sparkContext._jvm
    for path in paths:
        file_system, at = scratch._hadoop_path(spark, path)
        assert not file_system.exists(at)
    assert jvm is not None and exists(outside)
    with pytest.raises(ValueError, match="stop"), scratch.scope(spark) as own:
        scratch.materialize(spark.range(2), "failed")
        raise ValueError("stop")
    assert own.paths == []
