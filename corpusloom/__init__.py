"""corpusloom: a Spark-first engine for building, auditing and evaluating text and conversation corpora."""
