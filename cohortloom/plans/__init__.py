"""Whole reports: who is in a cohort, what they answered, crosstabs, and the regression."""
