"""Linkage-disequilibrium matrices on Spark: ingest, store, query, transform and export."""
