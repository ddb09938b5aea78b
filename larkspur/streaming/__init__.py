"""Incremental work: feeds, ledgers, followers."""
