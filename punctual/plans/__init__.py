"""The whole batch run, and the registered queries with their SQL."""
