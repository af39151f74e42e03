"""Options, registered queries and their SQL."""
