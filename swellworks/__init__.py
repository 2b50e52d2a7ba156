"""Wave-forecast analytics on Spark: bulletins in, typed forecasts, catalogues and table views out."""
