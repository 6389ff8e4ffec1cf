"""quillon: entity-attribution, graph and corpus analytics expressed as Spark DataFrame plans."""
