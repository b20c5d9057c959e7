"""Named queries over the star-schema tables, each with the SQL that checks it."""
