"""Every operator and report as a query on the sample tables, each with independent SQL."""
