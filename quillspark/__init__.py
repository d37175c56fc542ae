"""Document analytics on Spark: trees, chunk plans, prompts, folds and run state as DataFrame plans."""
