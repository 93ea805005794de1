"""Unstructured meshes as relations: generation, faces, partitions, geometry, validation."""
