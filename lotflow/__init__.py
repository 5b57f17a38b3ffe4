"""lotflow: inventory-ledger and event-workflow analytics as Spark DataFrame operators."""
