"""Web-document analytics on Spark: page tables in, clean analysable text out."""
