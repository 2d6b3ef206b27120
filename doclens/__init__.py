"""doclens: document extraction, checking and scoring as Spark DataFrame plans."""
