"""SQL twins used as the correctness oracle."""
