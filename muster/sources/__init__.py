"""Storage locations, the local-access policy and the ledger file source."""
