"""Named queries over the test tables, each with its reference SQL where SQL can express it."""
