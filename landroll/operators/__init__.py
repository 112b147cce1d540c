"""DataFrame-to-DataFrame jobs, one module per job family."""
