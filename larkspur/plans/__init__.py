"""What is decided before a plan is built: filters, options, predicates."""
