"""Whole jobs: matching, history links, recompetes, evaluation and reports."""
