"""Operators put together: the pipeline jobs and the registered workload."""
