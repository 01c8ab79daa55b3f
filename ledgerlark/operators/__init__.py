"""Data-processing operators of the core; each module holds one problem."""
