"""Tables from RDF data, as ordinary Spark jobs."""
