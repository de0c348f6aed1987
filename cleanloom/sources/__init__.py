"""Readers and writers."""

from cleanloom.sources.files import demo_accounts, demo_customers, preview, read_any, write_csv, write_excel

__all__ = ["demo_accounts", "demo_customers", "preview", "read_any", "write_csv", "write_excel"]
