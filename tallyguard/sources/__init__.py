"""Reading and writing: ledger, orders, catalog, cost, settings, finding state, ticket actions."""
