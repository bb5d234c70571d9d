"""reelframe: relational analytics over scripts, dialogue and text corpora on Apache Spark."""
