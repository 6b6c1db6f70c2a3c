"""DataFrame -> DataFrame operators of the conduct-point ledger."""
