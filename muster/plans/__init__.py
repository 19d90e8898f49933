"""Running a frame: stored results, partition counts and staged pipelines."""
