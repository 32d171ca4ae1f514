"""Test workload: clinical views of the supplied tables, queries over them, oracle SQL."""
