"""Benchmark tasks from configuration: a task is data, and is compiled into one DataFrame plan."""
