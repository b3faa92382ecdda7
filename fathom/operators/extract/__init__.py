"""Table functions: a file's text to rows of facts. Each is a pure function of one file (and of shared maps), run over Arrow batches."""
