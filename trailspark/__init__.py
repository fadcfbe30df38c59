"""Analytics over object trajectories as composable Spark DataFrames."""
