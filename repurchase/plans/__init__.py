"""Plans: parameters, the skew-safe sequence operator and the end-to-end
cohort-to-mart pipeline."""
