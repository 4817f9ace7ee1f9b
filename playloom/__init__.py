"""playloom: a play-session archive and its analytics, as Spark DataFrame programs."""
