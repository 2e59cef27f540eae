"""Packets of streams are packed once and dealt before they are decoded."""

from gridwake.plans import device_queries


def test_packets_of_streams_are_written_once(spark, sf):
    packets = device_queries._streams(spark, sf, False)
    assert packets.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "collect_list" not in packets._jdf.queryExecution().optimizedPlan().toString()
