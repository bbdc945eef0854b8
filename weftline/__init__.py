"""weftline: a Spark-first engine for curating and analysing web-text corpora."""
