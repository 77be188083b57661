"""Every query of the library with the SQL it must agree with.

`CHECKS[key]` builds the Spark result from the derived tables and names the DuckDB statement.
Double columns are rounded on both sides, since sums add up in another order; `digits` gives the
number of decimals per column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide.operators import rows
from blobtide.plans import charts, fees, inclusion, propagation, resubmission, rollups
from blobtide.scratch import materialize, scratch_path
from blobtide.session import configure
from blobtide.sources import files, inputs, scans
from verification.fixtures import FOUND_BLOB_COUNTS, FOUND_CLIENTS, SEQUENCER_MAPPING, Fixtures
from verification.fixtures_sql import FIXTURES
from verification.pipelines_sql import (
    COMPLETE,
    MEANS,
    PIPELINES,
    SCAN_BLOCK_EVENTS,
    SCAN_MEMPOOL,
    SCAN_SIDECAR,
    SPREAD,
)

# The whole of the derived tables lies within 31 days of this time.
AS_OF = datetime(2024, 1, 31)
DAYS = 31
# A day's window that leaves out the first slots at every scale factor.
PROPAGATION_AS_OF = datetime(2024, 1, 2, 1)
ROLLUPS = SEQUENCER_MAPPING["sequencer_names"]
ROLLUP_ADDRESS = "0xSEQ1"
SINCE = datetime(2024, 1, 1)

WEI = {c: 3 for c in MEANS}
FEES = {
    "base_tx_fee_eth": 12,
    "priority_tx_fee_eth": 12,
    "total_tx_fee_eth": 12,
    "base_fee_per_gas": 9,
    "priority_fee_gas": 9,
    "priority_fee_bid_percent_premium": 6,
    "slot_inclusion_rate": 6,
}
INCLUSION = {
    **WEI,
    "beacon_inclusion_time": 6,
    "slot_inclusion_rate": 6,
    "slot_inclusion_rate_50_blob_avg": 6,
}
JOINED = {**FEES, "fill_percentage": 3, "blob_hashes_length": 6}
BLOCKS = {
    "base_fees_per_block_eth": 9,
    "priority_fees_per_block_eth": 9,
    "total_tx_fees_per_block_eth": 9,
    "avg_slot_inclusion_rate_per_block": 6,
    "avg_priority_fee_gas_per_block_gwei": 9,
    "base_fee_per_gas": 9,
    "blobs_per_block": 6,
}
BIDS = {
    "gas_tip_diff": 3,
    "num_block_inclusion": 6,
    **{
        f"{side}_{c}": 3
        for side in ("min", "max")
        for c in ("gas_tip_cap", "gas_fee_cap", "blob_gas_fee_cap")
    },
}
ROLLUP_TX = {**WEI, "beacon_inclusion_time": 6, "num_block_inclusion": 6}
DELAY = {"propagation_slot_start_diff": 6}


class Tables:
    """The library's frames over the derived tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.raw = Fixtures(spark, sf_dir)

    @cached_property
    def mempool(self) -> DataFrame:
        return scans.scan_mempool(self.raw.mempool, AS_OF, DAYS)

    @cached_property
    def sidecar(self) -> DataFrame:
        return scans.scan_canonical_sidecar(self.raw.sidecar, AS_OF, DAYS)

    @cached_property
    def by_nonce(self) -> DataFrame:
        return inclusion.mempool_by_nonce(self.mempool)

    @cached_property
    def counted(self) -> DataFrame:
        return inclusion.submission_count(materialize(self.by_nonce, "collapsed"))

    @cached_property
    def matched(self) -> DataFrame:
        return inclusion.mempool_sidecar_join(
            inclusion.explode_blobs(self.counted), self.sidecar
        )

    @cached_property
    def joined(self) -> DataFrame:
        bundle = inputs.Inputs(self.mempool, self.sidecar, self.raw.txs, self.raw.sequencers)
        return fees.joined_from_inputs(bundle)

    @cached_property
    def filtered(self) -> DataFrame:
        return fees.filter_by_sequencer(self.joined, ROLLUPS)

    @cached_property
    def gas_groups(self) -> DataFrame:
        return fees.slot_gas_groupby(self.filtered)

    @cached_property
    def block_aggs(self) -> DataFrame:
        return rollups.block_agg(rollups.blob_block(self.joined))

    @cached_property
    def rollup_incl(self) -> DataFrame:
        return inclusion.process_rollup(self.mempool, self.sidecar, ROLLUP_ADDRESS)

    @cached_property
    def counts(self) -> DataFrame:
        return resubmission.resubmission_counts(self.mempool)

    @cached_property
    def canonical(self) -> DataFrame:
        return scans.scan_canonical_block(self.raw.canonical_block, AS_OF, DAYS)

    @cached_property
    def spread(self) -> DataFrame:
        return propagation.blob_sidecar_spread(self.raw.sidecar_event, AS_OF, DAYS)

    @cached_property
    def bsj(self) -> DataFrame:
        return propagation.block_sidecar_joined(
            scans.scan_block_events(self.raw.block_event, AS_OF, DAYS),
            self.canonical,
            self.spread,
            scans.scan_canonical_sidecar(
                self.raw.sidecar_client, AS_OF, DAYS, with_client=True
            ),
        )

    @cached_property
    def slot_prop(self) -> DataFrame:
        return propagation.slot_propagation(self.bsj)

    @cached_property
    def reorged(self) -> DataFrame:
        return propagation.reorged_blocks(self.bsj)

    @cached_property
    def labeled(self) -> DataFrame:
        return propagation.reorged_blocks_labeled(self.bsj)


@dataclass(frozen=True)
class Check:
    build: Callable[[Tables], DataFrame]
    sql: str
    digits: dict[str, int] = field(default_factory=dict)
    # list columns, compared as comma-separated text
    lists: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        columns = []
        for f in df.schema.fields:
            column = F.col(f"`{f.name}`")
            if f.name in self.digits:
                column = F.round(column, self.digits[f.name])
            elif f.name in self.lists:
                column = F.array_join(column, ",")
            elif f.dataType.typeName() == "integer":
                column = column.cast("bigint")
            columns.append(column.alias(f.name))
        return df.select(*columns)

    def statement(self) -> str:
        changes = [f'round("{c}", {d}) AS "{c}"' for c, d in self.digits.items()]
        changes += [f"array_to_string(\"{c}\", ',') AS \"{c}\"" for c in self.lists]
        replace = f" REPLACE ({', '.join(changes)})" if changes else ""
        return with_tables(f"SELECT *{replace} FROM ({self.sql}) result")


def with_tables(sql: str) -> str:
    """Put the common table expressions that `sql` mentions in front of it."""
    known = {**FIXTURES, **PIPELINES}
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed[name] = ""
                need(known[name])
                needed[name] = known[name]
                ordered.append(name)

    ordered: list[str] = []
    need(sql)
    tables = ", ".join(f"{name} AS MATERIALIZED ({known[name]})" for name in ordered)
    return f"WITH {tables} {sql}"


def _roundtrip_parquet(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "roundtrip")
    source = t.raw.mempool.drop("event_id")
    files.write_cached(source, path, partition_by=["meta_network_name"])
    return files.read_cached(t.spark, path, source.schema)


def _roundtrip_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    incl = inclusion.slot_inclusion(t.mempool, t.sidecar)
    files.export_csv(incl, path)
    return files.read_csv(t.spark, path, incl.schema)


def _input_counts(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "inputs")
    files.write_days(t.raw.mempool, f"{folder}/{inputs.MEMPOOL_TABLE}")
    files.write_days(
        t.raw.sidecar.withColumn("meta_consensus_implementation", F.lit(None).cast("string")),
        f"{folder}/{inputs.SIDECAR_TABLE}",
    )
    files.write_cached(t.raw.txs, f"{folder}/{inputs.TX_TABLE}")
    return inputs.load_inputs(
        t.spark, folder, AS_OF, producers=SEQUENCER_MAPPING
    ).counts()


_INPUT_MEMPOOL = """
SELECT * FROM fx_mempool
WHERE event_date_time > TIMESTAMP '2024-01-24 00:00:00' AND type = 3
  AND meta_network_name = 'mainnet'
  AND "from" IN (SELECT sequencer_addresses FROM fx_sequencers)"""

_PROFILE = """
SELECT hash, count(*) AS count,
       make_timestamp(CAST(sum(epoch_us(event_date_time)) // count(*) AS BIGINT))
         AS mean_event_date_time,
       avg(blob_gas_fee_cap / 1e9) AS blob_gas_fee_cap, avg(gas_price / 1e9) AS gas_price,
       avg(gas_tip_cap / 1e9) AS gas_tip_cap, avg(gas_fee_cap / 1e9) AS gas_fee_cap,
       arg_min(nonce, {{'t': event_date_time, 'n': nonce}}) AS nonce
FROM listed
WHERE blob_hashes = (SELECT blob_hashes FROM counts {where}
                     ORDER BY count DESC, event_date_time, blob_hashes LIMIT 1 OFFSET {skip})
GROUP BY hash"""
_GWEI = {c: 6 for c in ("blob_gas_fee_cap", "gas_price", "gas_tip_cap", "gas_fee_cap")}


def _density_2d_sql(column: str, bandwidths=(0.1, 1.0), cells=256, grid=100) -> str:
    axes = ", ".join(
        f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, stddev_samp({c}) AS sd_{c}" for c in "xy"
    )
    return f"""
WITH points AS (
  SELECT {column} / 1e9 AS x, num_block_inclusion AS y FROM rollup_incl
  WHERE {column} IS NOT NULL AND num_block_inclusion IS NOT NULL),
ranges AS (SELECT {axes}, count(*) AS total FROM points)
SELECT bandwidth, x, y,
       sum(n * exp(-0.5 * pow((x - at_x) / (bandwidth * sd_x), 2))
             * exp(-0.5 * pow((y - at_y) / (bandwidth * sd_y), 2)))
         / (any_value(total) * 2 * pi() * bandwidth * any_value(sd_x) * bandwidth
            * any_value(sd_y)) AS density
FROM (
  SELECT n, total, sd_x, sd_y,
         lo_x + (cx + 0.5) * (hi_x - lo_x) / {cells} AS at_x,
         lo_y + (cy + 0.5) * (hi_y - lo_y) / {cells} AS at_y,
         lo_x + i * ((hi_x - lo_x) / {grid - 1}) AS x, lo_y + j * ((hi_y - lo_y) / {grid - 1}) AS y
  FROM (
    SELECT least(floor((p.x - lo_x) / (hi_x - lo_x) * {cells}), {cells - 1}) AS cx,
           least(floor((p.y - lo_y) / (hi_y - lo_y) * {cells}), {cells - 1}) AS cy,
           count(*) AS n
    FROM points p, ranges GROUP BY cx, cy), ranges,
    range(0, {grid}) gx(i), range(0, {grid}) gy(j)),
  (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in bandwidths)}]) AS bandwidth)
GROUP BY bandwidth, x, y"""


_DENSITY = """
WITH ranges AS (
  SELECT has_blobs, reorged, count(*) AS total, min(propagation_slot_start_diff) AS lo,
         max(propagation_slot_start_diff) AS hi, stddev_samp(propagation_slot_start_diff) AS sd
  FROM labeled GROUP BY has_blobs, reorged),
cells AS (
  SELECT has_blobs, reorged,
         least(floor((propagation_slot_start_diff - lo) / (hi - lo) * 2048), 2047) AS cell,
         count(*) AS n
  FROM labeled JOIN ranges USING (has_blobs, reorged) GROUP BY ALL)
SELECT has_blobs, reorged, x,
       sum(n * exp(-0.5 * pow((x - center) / h, 2))) / (any_value(total) * any_value(h) * sqrt(2 * pi()))
         AS density
FROM (
  SELECT c.has_blobs, c.reorged, n, total, sd * pow(total, -0.2) AS h,
         lo + (cell + 0.5) * (hi - lo) / 2048 AS center, lo + i * ((hi - lo) / 511) AS x
  FROM cells c JOIN ranges USING (has_blobs, reorged), range(0, 512) g(i))
GROUP BY has_blobs, reorged, x"""

_BOX = """
WITH q AS (
  SELECT has_blobs, reorged, count(*) AS n_values,
         quantile_cont(propagation_slot_start_diff, 0.25) AS q1,
         quantile_cont(propagation_slot_start_diff, 0.5) AS median,
         quantile_cont(propagation_slot_start_diff, 0.75) AS q3
  FROM labeled GROUP BY has_blobs, reorged)
SELECT has_blobs, reorged, any_value(n_values) AS n_values, any_value(q1) AS q1,
       any_value(median) AS median, any_value(q3) AS q3,
       min(propagation_slot_start_diff) FILTER (inside) AS whisker_low,
       max(propagation_slot_start_diff) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM (SELECT *, propagation_slot_start_diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
               AS inside
      FROM labeled JOIN q USING (has_blobs, reorged))
GROUP BY has_blobs, reorged"""

_HISTOGRAM = """
WITH sides AS (
  SELECT propagation_slot_start_diff AS v,
         CASE WHEN slot_start_date_time_canonical_block IS NULL THEN 'reorged' ELSE 'finalized' END
           AS side
  FROM reorged),
ranges AS (SELECT side, min(v) AS lo, max(v) AS hi FROM sides GROUP BY side),
filled AS (
  SELECT side, CAST(least(floor((v - lo) / (hi - lo) * 100), 99) AS BIGINT) AS bin, count(*) AS n
  FROM sides JOIN ranges USING (side) GROUP BY ALL)
SELECT r.side, CAST(b.bin AS BIGINT) AS bin, lo + b.bin * ((hi - lo) / 100) AS bin_start,
       lo + (b.bin + 1) * ((hi - lo) / 100) AS bin_end, coalesce(n, 0) AS count
FROM ranges r CROSS JOIN range(0, 100) b(bin) LEFT JOIN filled f ON f.side = r.side AND f.bin = b.bin"""

_FEES_LONG = """
SELECT slot_time, sequencer_names, '{first}' AS fee, {first} AS amount FROM filtered
UNION ALL
SELECT slot_time, sequencer_names, '{second}', {second} FROM filtered"""

_INCL_COLUMNS = ", ".join(f'"{c}"' for c in inclusion.INCLUSION_COLUMNS)

CHECKS: dict[str, Check] = {
    # sources and sinks
    "scan_mempool": Check(
        lambda t: scans.scan_mempool(t.raw.mempool, AS_OF),
        SCAN_MEMPOOL.format(days=28),
        {"fill_percentage": 2},
        ("blob_hashes",),
    ),
    "scan_canonical_sidecar": Check(
        lambda t: scans.scan_canonical_sidecar(t.raw.sidecar, AS_OF),
        SCAN_SIDECAR.format(
            scope="meta_network_name", table="fx_sidecar", as_of=AS_OF, days=28
        ),
    ),
    "scan_block_events": Check(
        lambda t: scans.scan_block_events(t.raw.block_event, PROPAGATION_AS_OF),
        SCAN_BLOCK_EVENTS.format(as_of=PROPAGATION_AS_OF, days=1),
    ),
    "latest_per_key": Check(
        lambda t: rows.latest_per_key(t.raw.canonical_block, ["slot"], "version"),
        """SELECT * FROM fx_canonical_block
           QUALIFY row_number() OVER (PARTITION BY slot
                                      ORDER BY version DESC, slot_start_date_time DESC) = 1""",
    ),
    "scan_canonical_block": Check(lambda t: t.canonical, "SELECT * FROM canonical"),
    "blob_sidecar_spread": Check(
        lambda t: propagation.blob_sidecar_spread(t.raw.sidecar_event, PROPAGATION_AS_OF),
        SPREAD.format(as_of=PROPAGATION_AS_OF, days=1),
    ),
    "scan_txs": Check(
        lambda t: scans.scan_txs(t.raw.txs, t.mempool),
        "SELECT * FROM fx_txs WHERE hash IN (SELECT hash FROM mempool)",
    ),
    "parquet_roundtrip": Check(
        _roundtrip_parquet,
        "SELECT * EXCLUDE (event_id) REPLACE (CAST(type AS BIGINT) AS type) FROM fx_mempool",
        {},
        ("blob_hashes",),
    ),
    "csv_roundtrip": Check(_roundtrip_csv, f"SELECT {_INCL_COLUMNS} FROM incl", INCLUSION),
    "sequencer_dim": Check(
        lambda t: t.mempool.select("from")
        .distinct()
        .join(t.raw.sequencers, F.col("from") == F.col("sequencer_addresses"))
        .select("sequencer_addresses", "sequencer_names"),
        """SELECT * FROM fx_sequencers
           WHERE sequencer_addresses IN (SELECT "from" FROM mempool)""",
    ),
    "load_inputs_counts": Check(
        _input_counts,
        f"""SELECT 'mempool' AS table_name, count(*) AS row_count FROM ({_INPUT_MEMPOOL})
            UNION ALL SELECT 'sidecar', count(*) FROM fx_sidecar
            WHERE event_date_time > TIMESTAMP '2024-01-24 00:00:00'
              AND meta_network_name = 'mainnet'
            UNION ALL SELECT 'txs', count(*) FROM fx_txs
            WHERE hash IN (SELECT hash FROM ({_INPUT_MEMPOOL}))
            UNION ALL SELECT 'sequencers', count(*) FROM fx_sequencers""",
    ),
    # row operators
    "outlier_filter": Check(
        lambda t: rows.outlier_filter(
            scans.scan_block_events(t.raw.block_event, AS_OF, DAYS),
            "propagation_slot_start_diff",
            12500,
        ),
        "SELECT * FROM block_events WHERE propagation_slot_start_diff < 12500",
    ),
    "drop_null_rows": Check(
        lambda t: rows.drop_null_rows(t.raw.txs),
        "SELECT * FROM fx_txs WHERE extra_data IS NOT NULL",
    ),
    "fill_numeric_nulls": Check(
        lambda t: rows.fill_numeric_nulls(t.mempool),
        "SELECT * REPLACE (coalesce(fill_percentage, -1) AS fill_percentage) FROM mempool",
        {"fill_percentage": 2},
        ("blob_hashes",),
    ),
    "distinct_rows": Check(
        lambda t: rows.distinct_rows(
            t.mempool.select("hash", "from", "to", "nonce", "blob_hashes_length")
        ),
        """SELECT DISTINCT hash, "from", "to", nonce, blob_hashes_length FROM mempool""",
    ),
    # mempool to slot
    "mempool_by_nonce": Check(
        lambda t: t.by_nonce, "SELECT * FROM by_nonce", WEI, ("versioned_hash",)
    ),
    "mempool_by_tx": Check(
        lambda t: inclusion.mempool_by_tx(t.mempool),
        "SELECT * FROM by_tx",
        WEI,
        ("versioned_hash",),
    ),
    "submission_count": Check(
        lambda t: t.counted, "SELECT * FROM counted", WEI, ("versioned_hash",)
    ),
    "explode_blobs": Check(
        lambda t: inclusion.explode_blobs(t.counted), "SELECT * FROM exploded", WEI
    ),
    "mempool_sidecar_join": Check(lambda t: t.matched, "SELECT * FROM matched", WEI),
    "inclusion_time": Check(
        lambda t: inclusion.inclusion_time(t.matched),
        "SELECT * FROM timed",
        {**WEI, "beacon_inclusion_time": 6, "num_slot_inclusion": 6},
    ),
    "rolling_inclusion": Check(
        lambda t: inclusion.rolling_inclusion(
            inclusion.inclusion_time(t.matched, "slot_inclusion_rate")
            .withColumnRenamed("slot_start_date_time", "slot_time")
            .where(F.col("slot_time").isNotNull()),
            block_rows=500,
        ),
        """SELECT * EXCLUDE ("2_slot_target_inclusion_rate") FROM rolled
           WHERE slot_time IS NOT NULL""",
        INCLUSION,
    ),
    "slot_inclusion": Check(
        lambda t: inclusion.slot_inclusion(t.mempool, t.sidecar, ordered=True),
        f"SELECT {_INCL_COLUMNS} FROM incl",
        INCLUSION,
    ),
    "process_rollup": Check(lambda t: t.rollup_incl, "SELECT * FROM rollup_incl", ROLLUP_TX),
    # fees
    "fee_breakdown": Check(
        lambda t: fees.fee_breakdown(t.raw.txs),
        """SELECT hash, block_number, extra_data, gas_used, effective_gas_price,
                  max_priority_fee_per_gas,
                  base_fee_per_gas * gas_used / 1e18 AS base_tx_fee_eth,
                  (effective_gas_price - base_fee_per_gas) * gas_used / 1e18 AS priority_tx_fee_eth,
                  base_fee_per_gas * gas_used / 1e18
                    + (effective_gas_price - base_fee_per_gas) * gas_used / 1e18
                    AS total_tx_fee_eth,
                  base_fee_per_gas / 1e9 AS base_fee_per_gas,
                  (effective_gas_price - base_fee_per_gas) / 1e9 AS priority_fee_gas,
                  effective_gas_price / 1e9 AS effective_gas_price_gwei,
                  round(max_priority_fee_per_gas / effective_gas_price, 3)
                    AS priority_fee_bid_percent_premium
           FROM fx_txs""",
        {k: v for k, v in FEES.items() if k != "slot_inclusion_rate"}
        | {"effective_gas_price_gwei": 9},
    ),
    "builder_label": Check(
        lambda t: fees.builder_label(t.raw.txs).select("hash", "extra_data", "builder_label"),
        "SELECT hash, extra_data, builder_label FROM tx_labels",
    ),
    "slot_gas_bidding": Check(
        lambda t: fees.slot_gas_bidding(
            inclusion.included_blobs(t.mempool, t.sidecar), t.raw.txs
        ),
        "SELECT * FROM gas",
        FEES,
    ),
    "bid_premium": Check(
        lambda t: fees.bid_premium(inclusion.included_blobs(t.mempool, t.sidecar), t.raw.txs),
        """SELECT slot_inclusion_rate,
                  median(priority_fee_bid_percent_premium) AS priority_fee_bid_percent_premium,
                  avg(effective_gas_price_gwei) AS effective_gas_price_gwei
           FROM (SELECT DISTINCT block_number, extra_data, builder_label, base_tx_fee_eth,
                        priority_tx_fee_eth, total_tx_fee_eth, base_fee_per_gas, priority_fee_gas,
                        meta_network_name, priority_fee_bid_percent_premium, slot_inclusion_rate,
                        submission_count, hash, "from", effective_gas_price_gwei
                 FROM fees
                 WHERE block_number IS NOT NULL AND extra_data IS NOT NULL
                   AND priority_fee_bid_percent_premium IS NOT NULL)
           WHERE slot_inclusion_rate < 50 GROUP BY slot_inclusion_rate""",
        {
            "slot_inclusion_rate": 6,
            "priority_fee_bid_percent_premium": 6,
            "effective_gas_price_gwei": 9,
        },
    ),
    "inclusion_with_rollup": Check(
        lambda t: fees.inclusion_with_rollup(
            inclusion.slot_inclusion(t.mempool, t.sidecar), t.raw.sequencers
        ),
        f"SELECT {_INCL_COLUMNS}, sequencer_names FROM with_rollup",
        INCLUSION,
    ),
    "inclusion_joined": Check(lambda t: t.joined, "SELECT * FROM joined", JOINED),
    "filter_by_sequencer": Check(lambda t: t.filtered, "SELECT * FROM filtered", JOINED),
    "slot_gas_groupby": Check(
        lambda t: t.gas_groups,
        "SELECT * FROM gas_groups",
        {
            "slot_inclusion_rate": 6,
            "priority_fee_bid_percent_premium": 6,
            "base_fee_per_gas": 9,
        },
    ),
    # blocks, rollups, builders
    "blob_block": Check(
        lambda t: rollups.blob_block(t.joined), "SELECT * FROM blob_blocks", BLOCKS
    ),
    "block_agg": Check(lambda t: t.block_aggs, "SELECT * FROM block_aggs", BLOCKS),
    "cumulative_fees": Check(
        lambda t: rollups.cumulative_fees(t.block_aggs),
        """SELECT *, sum(base_fees_per_block_eth) OVER w AS "base fee",
                  sum(priority_fees_per_block_eth) OVER w AS "priority fee"
           FROM block_aggs WINDOW w AS (ORDER BY slot_time ROWS UNBOUNDED PRECEDING)""",
        {**BLOCKS, "base fee": 9, "priority fee": 9},
    ),
    "rollup_macro": Check(
        lambda t: rollups.rollup_macro(t.joined),
        "SELECT * FROM macro",
        {
            "avg_fill_percentage": 6,
            "avg_submission_count": 6,
            "avg_slot_inclusion_rate": 3,
            "avg_blobs_in_tx": 6,
            "blob_count": 6,
            "total_base_fees_eth": 3,
            "total_priority_fees_eth": 3,
            "total_eth_fees": 3,
            "avg_priority_fee_bid": 3,
        },
    ),
    "rollup_summary": Check(
        lambda t: rollups.rollup_summary(rollups.rollup_macro(t.joined)),
        "SELECT rollup, avg_blobs_in_tx, blob_count, tx_count, total_eth_fees FROM macro",
        {"avg_blobs_in_tx": 6, "blob_count": 6, "total_eth_fees": 3},
    ),
    "builder_table": Check(
        lambda t: rollups.builder_table(t.joined),
        "SELECT * FROM builders",
        {"slot_inclusion_rate": 3, rollups.FEES_COLLECTED: 3, "blob_hashes_length": 3},
    ),
    "top_builders": Check(
        lambda t: rollups.top_builders(rollups.builder_table(t.joined)),
        "SELECT * FROM builders ORDER BY blob_tx_count DESC, builder_label LIMIT 10",
        {"slot_inclusion_rate": 3, rollups.FEES_COLLECTED: 3, "blob_hashes_length": 3},
    ),
    # resubmission
    "resubmission_window": Check(
        lambda t: resubmission.resubmission_window(
            t.mempool, datetime(2024, 1, 3), datetime(2024, 1, 30), min_count=4
        ),
        """SELECT blob_hashes, count(*) AS count FROM listed
           WHERE event_date_time > TIMESTAMP '2024-01-03' AND event_date_time < TIMESTAMP '2024-01-30'
           GROUP BY blob_hashes HAVING count(*) > 4""",
    ),
    "resubmission_counts": Check(lambda t: t.counts, "SELECT * FROM counts"),
    "resubmission_series": Check(
        lambda t: resubmission.resubmission_series(t.counts, min_count=4),
        "SELECT event_date_time, count FROM counts WHERE count > 4",
    ),
    "worst_case_resubmission": Check(
        lambda t: resubmission.worst_case_resubmission(t.mempool, t.counts),
        _PROFILE.format(where="", skip=0),
        _GWEI,
    ),
    "median_case_resubmission": Check(
        lambda t: resubmission.worst_case_resubmission(t.mempool, t.counts, rank=2, count=6),
        _PROFILE.format(where="WHERE count = 6", skip=1),
        _GWEI,
    ),
    "nonce_neighbourhood": Check(
        lambda t: resubmission.nonce_neighbourhood(t.counts, 40, 80),
        "SELECT * FROM counts WHERE nonce > 40 AND nonce < 80",
    ),
    "followup_by_nonce": Check(
        lambda t: resubmission.followup_by_nonce(t.mempool, t.counts, 16),
        """SELECT * FROM listed
           WHERE blob_hashes IN (SELECT blob_hashes FROM counts WHERE nonce = 16)""",
        {"fill_percentage": 2},
    ),
    "submission_histogram": Check(
        lambda t: resubmission.submission_histogram(t.rollup_incl),
        """SELECT submission_count, count(*) / 6.0 AS count FROM rollup_incl
           GROUP BY submission_count""",
        {"count": 6},
    ),
    "bid_range": Check(
        lambda t: resubmission.bid_range(t.rollup_incl), "SELECT * FROM bids", BIDS
    ),
    "top_bid_range": Check(
        lambda t: resubmission.top_bid_range(t.rollup_incl),
        """SELECT * FROM bids
           ORDER BY submission_count DESC, nonce NULLS FIRST, versioned_hash NULLS FIRST
           LIMIT 10""",
        BIDS,
    ),
    "bid_stats": Check(
        lambda t: resubmission.bid_stats(t.rollup_incl),
        """SELECT submission_count, count(*) AS agg_count,
                  round(avg(num_block_inclusion), 3) AS "block inclusion mean",
                  round(avg((max_gas_fee_cap - min_gas_fee_cap) / 1e9), 3) AS gas_diff_mean
           FROM bids GROUP BY submission_count""",
        {"block inclusion mean": 3, "gas_diff_mean": 3},
    ),
    # propagation
    "block_sidecar_joined": Check(lambda t: t.bsj, "SELECT * FROM bsj"),
    "block_blob_table": Check(
        lambda t: propagation.block_blob_table(t.bsj),
        "SELECT * FROM client_table",
        {"mean_propagation_slot_start_diff": 6, "mean_block_size_compressed": 6},
    ),
    "propagation_pivot": Check(
        lambda t: propagation.propagation_pivot(propagation.block_blob_table(t.bsj)),
        "SELECT max_blob_index, "
        + ", ".join(
            "max(CASE WHEN meta_consensus_implementation = "
            f"'{c}' THEN mean_propagation_slot_start_diff / 1000 END) AS {c}"
            for c in FOUND_CLIENTS
        )
        + " FROM client_table GROUP BY max_blob_index",
        {c: 6 for c in FOUND_CLIENTS},
    ),
    "slot_propagation": Check(lambda t: t.slot_prop, "SELECT * FROM slot_prop", DELAY),
    "propagation_by_blobs": Check(
        lambda t: propagation.propagation_by_blobs(t.slot_prop),
        "SELECT * FROM slot_pivot",
        {f"blobs_{n}": 6 for n in FOUND_BLOB_COUNTS},
    ),
    "slow_one_blob_slots": Check(
        lambda t: propagation.slow_one_blob_slots(t.slot_prop),
        "SELECT * FROM slot_pivot WHERE blobs_1 > 8000",
        {f"blobs_{n}": 6 for n in FOUND_BLOB_COUNTS},
    ),
    "rolling_propagation": Check(
        lambda t: propagation.rolling_propagation(t.slot_prop),
        """SELECT slot_start_date_time, blobs_0 / 1000 AS blobs_0, blobs_1 / 1000 AS blobs_1,
                  avg(blobs_0 / 1000) OVER w AS rolling_blobs_0,
                  avg(blobs_1 / 1000) OVER w AS rolling_blobs_1
           FROM slot_pivot
           WINDOW w AS (ORDER BY slot_start_date_time
                        ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)""",
        {c: 6 for c in ("blobs_0", "blobs_1", "rolling_blobs_0", "rolling_blobs_1")},
    ),
    "reorged_blocks": Check(lambda t: t.reorged, "SELECT * FROM reorged"),
    "reorged_blocks_labeled": Check(lambda t: t.labeled, "SELECT * FROM labeled", DELAY),
    "split_reorged": Check(
        lambda t: propagation.split_reorged(t.reorged),
        """SELECT *, CASE WHEN slot_start_date_time_canonical_block IS NULL THEN 'reorged'
                          ELSE 'finalized' END AS side FROM reorged""",
    ),
    "missed_by_blob_count": Check(
        lambda t: propagation.missed_by_blob_count(t.reorged, SINCE),
        """SELECT blob_count, count(*) FILTER (block_canonical_block IS NULL) AS missed_blocks,
                  count(*) FILTER (block_canonical_block IS NOT NULL) AS finalized_blocks
           FROM reorged WHERE slot_start_date_time > TIMESTAMP '2024-01-01'
           GROUP BY blob_count""",
    ),
    "missed_by_blob_client": Check(
        lambda t: propagation.missed_by_blob_client(t.reorged, SINCE),
        """SELECT blob_count, meta_consensus_implementation,
                  count(*) FILTER (block_canonical_block IS NULL) AS missed_blocks,
                  count(*) FILTER (block_canonical_block IS NOT NULL) AS finalized_blocks
           FROM reorged WHERE slot_start_date_time > TIMESTAMP '2024-01-01'
           GROUP BY blob_count, meta_consensus_implementation""",
    ),
    # chart data
    "inclusion_line_data": Check(
        lambda t: charts.inclusion_line_data(t.filtered, ROLLUPS),
        """SELECT slot_time, slot_inclusion_rate, submission_count, sequencer_names,
                  CAST(2 AS BIGINT) AS "2_slot_target_inclusion_rate" FROM filtered""",
        {"slot_inclusion_rate": 6},
    ),
    "premium_scatter_data": Check(
        lambda t: charts.premium_scatter_data(t.filtered, ROLLUPS),
        """SELECT slot_inclusion_rate, priority_fee_bid_percent_premium, sequencer_names
           FROM filtered WHERE slot_inclusion_rate < 100""",
        {"slot_inclusion_rate": 6, "priority_fee_bid_percent_premium": 6},
    ),
    "premium_line_data": Check(
        lambda t: charts.premium_line_data(t.gas_groups, ROLLUPS),
        """SELECT slot_inclusion_rate, sequencer_names,
                  priority_fee_bid_percent_premium AS "priority fee bid premium (%)",
                  base_fee_per_gas
           FROM gas_groups WHERE slot_inclusion_rate < 100""",
        {
            "slot_inclusion_rate": 6,
            "priority fee bid premium (%)": 6,
            "base_fee_per_gas": 9,
        },
    ),
    "fee_gwei_long": Check(
        lambda t: charts.fee_gwei_long(t.filtered, ROLLUPS),
        _FEES_LONG.format(first="base_fee_per_gas", second="priority_fee_gas"),
        {"amount": 9},
    ),
    "fee_eth_long": Check(
        lambda t: charts.fee_eth_long(t.filtered, ROLLUPS),
        _FEES_LONG.format(first="base_tx_fee_eth", second="priority_tx_fee_eth"),
        {"amount": 12},
    ),
    "fees_vs_inclusion": Check(
        lambda t: charts.fees_vs_inclusion(t.block_aggs),
        """SELECT slot_time, total_tx_fees_per_block_eth, avg_slot_inclusion_rate_per_block,
                  base_fee_per_gas FROM block_aggs""",
        {
            "total_tx_fees_per_block_eth": 9,
            "avg_slot_inclusion_rate_per_block": 6,
            "base_fee_per_gas": 9,
        },
    ),
    "inclusion_table": Check(
        lambda t: charts.inclusion_table(t.filtered, ROLLUPS),
        f"SELECT * FROM filtered WHERE {COMPLETE}",
        JOINED,
    ),
    "rollup_inclusion_scatter": Check(
        lambda t: charts.rollup_inclusion_scatter(t.rollup_incl),
        "SELECT slot_start_date_time, num_block_inclusion FROM rollup_incl",
        {"num_block_inclusion": 6},
    ),
    "propagation_histogram": Check(
        lambda t: charts.propagation_histogram(t.reorged),
        _HISTOGRAM,
        {"bin_start": 6, "bin_end": 6},
    ),
    "propagation_box_stats": Check(
        lambda t: charts.propagation_box_stats(t.labeled),
        _BOX,
        {c: 6 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")},
    ),
    "propagation_density": Check(
        lambda t: charts.propagation_density(t.labeled), _DENSITY, {"x": 6, "density": 6}
    ),
    "gas_cap_density": Check(
        lambda t: charts.gas_cap_density(t.rollup_incl),
        _density_2d_sql("gas_fee_cap"),
        {"x": 6, "y": 6, "density": 6},
    ),
    "blob_gas_cap_density": Check(
        lambda t: charts.blob_gas_cap_density(t.rollup_incl),
        _density_2d_sql("blob_gas_fee_cap"),
        {"x": 6, "y": 6, "density": 6},
    ),
}
