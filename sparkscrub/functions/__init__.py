"""Pure ``Column -> Column`` building blocks: no DataFrame, no action, no Python UDF."""
