"""An entity-registry engine on Spark: layered records, identity resolution, curation, search and name statistics."""
