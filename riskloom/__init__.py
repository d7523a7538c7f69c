"""riskloom: change-risk analytics for source code as Spark plans."""
