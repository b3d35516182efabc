"""vakya: dependency-treebank analytics and corpus preparation on Spark DataFrames."""
