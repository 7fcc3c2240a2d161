"""Part of Ledgerweave."""
