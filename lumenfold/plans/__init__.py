"""Named queries over the tables, with the SQL that states each of them."""
