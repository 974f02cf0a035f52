"""Partition counts for work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, spread over all cores; any larger scan as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)
