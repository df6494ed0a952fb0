"""Part of the ledger verification package."""
