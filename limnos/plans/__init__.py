"""End-to-end jobs (stage 1 prepare, stage 2 features, stage 3 training) and
the query catalogue bound to the test tables."""
