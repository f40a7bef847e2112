"""Table-level jobs that build and check the datasets."""
