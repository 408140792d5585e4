"""Composite plans: measures, call filters, genotype models, callers, phasing; and the query registry."""
