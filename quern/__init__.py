"""Knowledge-base analytics on Spark: articles, ingest, search, validation, project scans."""
