"""quillframe: record syntaxes, typed schemas, text and XML trees as PySpark columns and frames."""
