"""folioframe: DataFrame and SQL operators for document collections held as tables."""
