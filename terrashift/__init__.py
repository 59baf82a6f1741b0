"""terrashift: land-conversion analytics on Spark DataFrames."""

from terrashift.config import ClusterSpec, Experiment, FoldSpec, Lattice, PoolSpec

__all__ = ["ClusterSpec", "Experiment", "FoldSpec", "Lattice", "PoolSpec"]
