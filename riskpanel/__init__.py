"""Entity-month risk panels on Spark: features, labels, scoring and ranking evaluation."""
