"""Plan-level helpers: shared scratch tables and iterative graph plans."""
