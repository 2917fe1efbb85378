"""Move, drain, load, merge and compaction plans as DataFrames."""
