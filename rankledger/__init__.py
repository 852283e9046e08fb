"""rankledger: published competition results to auditable, versioned season rankings, on Spark DataFrames."""
