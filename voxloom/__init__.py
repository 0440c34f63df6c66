"""voxloom: Spark-native analytics for voxel time series, connectivity and cohort references."""
