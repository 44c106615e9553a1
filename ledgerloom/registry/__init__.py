"""Named queries over the sample tables, and the SQL each must agree with."""
