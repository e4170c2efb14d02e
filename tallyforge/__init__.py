"""tallyforge: Spark-native analytics over code-base facts, dependency graphs and quality verdicts."""
