"""The three stages: merge, preprocess, profile; and their reports."""
