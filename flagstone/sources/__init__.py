from flagstone.sources.fixtures import duckdb_fixture, duckdb_with, fixture

__all__ = ["fixture", "duckdb_fixture", "duckdb_with"]
