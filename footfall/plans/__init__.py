"""The workloads end to end, from source tables to results."""
