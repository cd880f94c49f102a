"""Code-usage analytics on Spark: idempotent counter merging, usage findings, call-graph clusters."""
