"""Incremental runs: files as a stream through a policy, with checkpointed recovery."""
