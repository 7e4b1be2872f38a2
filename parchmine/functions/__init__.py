"""Functions on texts and HTML tables, plain and as Arrow-batched columns."""
