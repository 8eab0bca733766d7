"""Team-sport tracking and event analytics as Spark DataFrame builders."""
