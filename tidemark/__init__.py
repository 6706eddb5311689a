"""tidemark: record linkage and progress reconciliation as Spark jobs."""
