"""convmem: conversation memory and corpus preparation as Spark jobs."""
