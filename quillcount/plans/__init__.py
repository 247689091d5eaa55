"""Whole plans: registered queries, their SQL, and reports."""
