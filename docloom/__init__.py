"""docloom: document analytics and training-data preparation as Spark jobs."""
