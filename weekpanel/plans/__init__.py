"""Plans: the full panel build, the test-table stand-ins, the query registry."""
