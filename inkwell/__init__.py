"""inkwell: Spark-native processing of code-completion workloads at collection scale."""
