"""Where samples come from: tables, ingest documents, mocked series; and where results go."""
