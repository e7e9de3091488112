"""Plan building blocks: shared scratch tables, checked joins, iterative graph plans."""
