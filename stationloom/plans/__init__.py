"""Composites: cleaning, features, clustering, classification, scoring and reports."""
