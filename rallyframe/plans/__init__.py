"""Multi-step plans: the batch build and the star schema."""
