"""Spark-native analytics for multi-frame point clouds: voxel indexing, segmentation, tracking, scoring."""
