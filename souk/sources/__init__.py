"""Contracts, readers, generators and the table store."""
