"""Readers, writers and the bindings of the bundled tables to logical inputs."""
