"""Column expressions: draws, predicates, likelihoods, edit distance."""
