"""Steps of a traversal, path search, and changes of a graph."""
