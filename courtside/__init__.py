"""courtside: a Spark-native analytics engine for team-sport scouting."""
