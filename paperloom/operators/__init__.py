"""DataFrame -> DataFrame transforms, one module per stage."""
