"""DataFrame operators: degrees, offsets, partitions, messages, checks, per-key aggregates."""
