"""Named queries over the provided tables, each beside its SQL twin where SQL can say it."""
