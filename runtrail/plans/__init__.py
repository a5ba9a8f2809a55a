"""Plans over whole tables: reports, and the queries that the driver runs."""
