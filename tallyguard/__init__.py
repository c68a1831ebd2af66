"""Inventory-ledger data-quality checks, finding lifecycle and reporting as Spark DataFrame operators."""
