"""Named queries over bound tables, each with its SQL check where SQL can state it."""
