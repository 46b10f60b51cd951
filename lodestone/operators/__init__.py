"""Table operators: chunking, vector and lexical search, fusion, composite search."""
