"""Column expressions shared by the operators (all native Spark functions)."""
