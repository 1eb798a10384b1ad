"""pathloom: customer-journey analytics and corpus preparation on Spark DataFrames."""
