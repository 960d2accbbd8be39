"""loomwright: Spark-first preparation of interaction tables, sequences, structures and text corpora."""
