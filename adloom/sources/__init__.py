"""Reading and writing ad tables and page tables."""
