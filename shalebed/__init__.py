"""A searchable block archive, its index and its analyses as Spark DataFrames."""
