"""Ledger verification and corpus preparation as Spark plans."""
