"""Spark-native record intake, ledger fan-out and contribution accounting."""
