"""Queries whose input is a small file that grows into many points."""

import pytest

from gridwake.plans import device_queries


@pytest.mark.parametrize("name", ["d15_angle_packets", "d16_vector_packets", "d19_column_packets"])
def test_packets_of_a_small_file_are_dealt_over_the_cores(spark, sf, name):
    assert device_queries.Q[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
