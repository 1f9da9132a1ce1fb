"""The analyses, one function each: tables in, DataFrame out."""
