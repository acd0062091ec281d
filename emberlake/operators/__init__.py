"""Analytics operators: DataFrame to DataFrame."""
