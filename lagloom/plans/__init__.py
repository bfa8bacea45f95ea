"""Named queries over the tables of a folder, each with the SQL that states its result."""
