"""All queries by name, with the SQL that checks them."""
