"""Named queries: each takes (spark, folder of tables) and returns a DataFrame; most have SQL that says the same."""
