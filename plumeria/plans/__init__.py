"""Registered queries, the batch and resume pipelines, and the result cache."""
