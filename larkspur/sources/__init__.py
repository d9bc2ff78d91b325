"""Collections on storage: snapshots, catalog, archives."""
