"""Readers, writers and the bindings of the provided tables to logical inputs."""
