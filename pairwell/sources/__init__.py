"""Sources and sinks: cohorts from any DataFrame, and report files."""
