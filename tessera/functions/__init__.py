"""Column functions over text, vectors and scalars; every one stays inside Catalyst."""
