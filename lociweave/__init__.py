"""Analytics over sequencing-alignment records and genomic intervals as Spark DataFrame transformations."""
