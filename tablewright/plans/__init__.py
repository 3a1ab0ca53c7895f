"""End-to-end plans: orchestration, the CRUD harness and the query catalogue."""
