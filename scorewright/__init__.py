"""Evaluation analytics on Spark: records, answer extraction, metrics, roll-ups and leaderboards as DataFrame plans."""
