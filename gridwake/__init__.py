"""gridwake: a PySpark-native engine for point clouds, trajectories and training-data pipelines."""
