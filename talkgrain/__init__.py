"""talkgrain: conversation analytics as PySpark DataFrame operators."""
