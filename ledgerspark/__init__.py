"""Ledgers, lifecycle folds, rules and query-ready views as Spark DataFrame operations."""
