"""leadloom: business-list analytics and data cleaning expressed as Spark plans."""
