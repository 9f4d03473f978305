"""Small-business loan portfolio analytics as Spark jobs."""
