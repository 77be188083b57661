"""The rollup dimension: sender address to rollup name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blobtide.schemas import SEQUENCERS

# Checksummed sender addresses and the rollup each belongs to.
ROLLUP_SEQUENCERS = {
    "sequencer_addresses": [
        "0xC1b634853Cb333D3aD8663715b08f41A3Aec47cc",
        "0x5050F69a9786F081509234F1a7F4684b5E5b76C9",
        "0x6887246668a3b87F54DeB3b94Ba47a6f63F32985",
        "0x000000633b68f5D8D3a86593ebB815b4663BCBe0",
        "0x415c8893D514F9BC5211d36eEDA4183226b84AA7",
        "0xa9268341831eFa4937537bc3e9EB36DbecE83C7e",
        "0xcF2898225ED05Be911D3709d9417e86E0b4Cfc8f",
        "0x0D3250c3D5FAcb74Ac15834096397a3Ef790ec99",
        "0xC70ae19B5FeAA5c19f576e621d2bad9771864fe2",
        "0xC94C243f8fb37223F3EB2f7961F7072602A51B8B",
    ],
    "sequencer_names": [
        "arbitrum",
        "base",
        "optimism",
        "taiko",
        "blast",
        "linea",
        "scroll",
        "zksync",
        "paradex",
        "metal",
    ],
}


def sequencer_dim(
    spark: SparkSession, mapping: dict[str, list[str]] | None = None
) -> DataFrame:
    """Dimension frame from a dict of equally long columns.

    Made from an Arrow table it is a local relation with an exact size, so Spark broadcasts it
    by its own threshold. A list of rows would become an RDD of unknown size.
    """
    mapping = ROLLUP_SEQUENCERS if mapping is None else mapping
    table = pa.table({name: mapping[name] for name in SEQUENCERS.fieldNames()})
    return spark.createDataFrame(table, SEQUENCERS)
