"""Message-moderation analytics and training-data operators on Spark."""
