"""Planning of compaction."""
