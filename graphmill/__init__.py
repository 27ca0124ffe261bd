"""graphmill: property-graph, retrieval and corpus analytics as Spark DataFrame plans."""
