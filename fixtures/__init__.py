"""The driver's tables seen as the library's tables, and the checked queries."""
