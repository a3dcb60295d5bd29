"""One runnable query per operator over the test tables, with the SQL that must agree with it."""
