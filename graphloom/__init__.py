"""graphloom: SPARQL 1.1 over relational tables and RDF quads, compiled to Spark DataFrames."""
