"""Column functions: regions, cigars, sequences, phred scores, log-space arithmetic, alleles."""
