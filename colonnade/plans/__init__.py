"""Multi-step work: preparation pipelines, model comparison, tuning, curves."""
