"""Query catalogue: each query as a DataFrame plan and as oracle SQL."""
