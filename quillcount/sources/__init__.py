"""Where sources, catalogs and configurations come from."""
