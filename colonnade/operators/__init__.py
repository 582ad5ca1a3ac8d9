"""Reports and relational operators: DataFrame in, DataFrame out."""
