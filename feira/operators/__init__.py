"""DataFrame -> DataFrame operators of the revenue and delivery analyses."""
